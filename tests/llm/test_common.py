import os
import time

from pyspark.sql import functions as F


def test_shuffle_files_of_a_written_table_go(spark):
    from millrace.llm.common import SHUFFLE_CLEANUP, materialise
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    held = lambda: {f for folder in folders for _, _, files in os.walk(folder) for f in files if f.startswith("shuffle_")}
    before, setting = held(), spark.conf.get(SHUFFLE_CLEANUP, "false")
    table = materialise(spark.range(20_000).groupBy((F.col("id") % 9_000).alias("k")).count(), "t")
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before
    assert spark.conf.get(SHUFFLE_CLEANUP) == setting
    assert table.count() == 9_000
