"""Session construction and lineage cutting.

Library functions never create a session; they take DataFrames. These
helpers exist for tests, ``bench.py`` and the command-line jobs.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "millrace", extra: dict | None = None) -> SparkSession:
    """A session with AQE on, UTC time, Arrow on and the UI off.

    Only settings that the user (spark-submit, spark-defaults, an existing
    session) has left unset get our defaults; ``shuffle_partitions`` and
    ``extra`` are explicit and always win. Without ``shuffle_partitions`` the
    cluster's own value stands."""
    from pyspark import SparkConf, SparkContext
    if "PYSPARK_GATEWAY_PORT" in os.environ:       # started by spark-submit: its settings are visible from here on
        SparkContext._ensure_initialized()
    active = SparkSession.getActiveSession()
    given = SparkConf()
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {k: v for k, v in DEFAULTS.items()
            if not given.contains(k) and (active is None or active.conf.get(k, None) is None)}
    if (master or given.get("spark.master", "")).startswith("local") and not given.contains("spark.driver.memory"):
        conf["spark.driver.memory"] = "16g"
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster for reliable checkpoints.

    Read from the session (``SparkContext`` checkpoint dir or
    ``spark.checkpoint.dir``). Only a local-mode session without one gets a
    private folder; on a cluster a missing setting is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="millrace-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS/S3)")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (materialised in the shared checkpoint folder).

    The input is persisted around the checkpoint: an eager reliable
    checkpoint otherwise computes its input twice (once to count, once to
    write the files)."""
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Round-robin a DataFrame that arrives in fewer partitions than the
    cluster has cores (a small file is one split), before CPU-heavy per-row
    work. Inputs that already span the cluster (the normal case at scale)
    pass through untouched, so no corpus-wide shuffle is added."""
    target = df.sparkSession.sparkContext.defaultParallelism * per_core
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)
