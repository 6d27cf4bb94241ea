"""ST1, ST2: the same transforms as incremental Structured Streaming runs.

ST1 ``ingest_stream``: landing directory -> text extraction -> split ->
Parquet partitioned by split (file sink, exactly once through the query's
checkpoint). ST2 ``monitor_stream``: step log -> per-run last step, best
validation loss, tokens and a non-finite flag.

ST2 keeps its keyed state in the published folder. A micro-batch is aggregated
by itself and merged with the open runs of the epoch before; runs that have
not logged for ``expire`` of log time move to a closed part, which no later
batch reads again. So a batch costs its own rows and the runs still open,
nothing is held between batches, and a run that logs again after it was closed
is opened anew: its parts add up when the table is read. Every epoch writes
folders of its own, from those of the epoch before; a replayed epoch writes the
same ones again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.config import SplitConfig
from millrace.operators.runlog import finite_or_null
from millrace.operators.split import split_texts


def read_landing(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                 glob: str | None = None, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def read_table_landing(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """The files of the Parquet table ``name`` in ``folder`` as a stream, be the table one file or a folder of
    them. (As a pattern, the path may name either; a plain path of a stream has to be a folder.)"""
    return read_landing(spark, f"{folder.rstrip('/')}/{name}.parque[t]", schema)


def ingest_stream(stream: DataFrame, out_path: str, checkpoint: str, cfg: SplitConfig = SplitConfig(),
                  text_fields=("text",), key_col: str | None = None):
    """ST1: starts the query (``availableNow``: drain what has landed, stop)."""
    rows = split_texts(stream, cfg, text_fields, key_col).drop("u")
    return (rows.writeStream.format("parquet").option("path", out_path)
                .option("checkpointLocation", checkpoint).partitionBy("split")
                .trigger(availableNow=True).start())


def monitor_aggregates(steps: DataFrame) -> DataFrame:
    """ST2 as a batch: a row per run."""
    return _totals(_parts(steps)).drop("last_time")


def _parts(steps: DataFrame) -> DataFrame:
    bad = F.lit(False)
    for c in ("train_loss", "grad_norm"):          # the flag of G8
        if c in steps.columns:
            bad = bad | (F.col(c).isNotNull() & finite_or_null(F.col(c)).isNull())
    logged = F.col("log_time") if "log_time" in steps.columns else F.lit(None)
    return steps.select("run_id", F.col("step").alias("last_step"), F.col("val_loss").alias("best_val_loss"),
                        F.col("tokens").cast("bigint").alias("tokens_seen"), bad.alias("had_nan"), logged.cast("timestamp").alias("last_time"))


def _totals(parts: DataFrame) -> DataFrame:
    """Rows or totals of runs added up; any grouping of them gives the same."""
    return parts.groupBy("run_id").agg(F.max("last_step").alias("last_step"), F.min("best_val_loss").alias("best_val_loss"),
                                       F.sum("tokens_seen").alias("tokens_seen"), F.bool_or("had_nan").alias("had_nan"), F.max("last_time").alias("last_time"))


def publish_monitor(batch: DataFrame, epoch: int, out_path: str, expire: str | None = None) -> None:
    """ST2: merges a micro-batch of steps into the published folder as ``epoch``."""
    spark = batch.sparkSession
    now = _totals(_parts(batch))
    if epoch > 0:
        before = spark.read.schema(now.schema).parquet(f"{out_path}/open/epoch={epoch - 1}")
        now = _totals(before.unionByName(now))
    now = now.persist()
    try:
        closes = F.lit(False)
        newest = now.agg(F.max("last_time")).first()[0] if expire else None
        if newest is not None:
            closes = F.coalesce(F.col("last_time") < F.lit(newest) - F.expr(f"INTERVAL {expire}"), F.lit(False))
        now.where(closes).write.mode("overwrite").parquet(f"{out_path}/closed/epoch={epoch}")
        now.where(~closes).write.mode("overwrite").parquet(f"{out_path}/open/epoch={epoch}")
        spark.range(1).select(F.lit(epoch).alias("done")).write.mode("overwrite").parquet(f"{out_path}/commits/epoch={epoch}")
    finally:
        now.unpersist()


def monitor_stream(steps: DataFrame, out_path: str, checkpoint: str, expire: str | None = None):
    """ST2: starts the query (``availableNow``). ``expire``: an interval of log time ("7 days") after which a
    silent run is closed; without it, or without log times, runs stay open. A folder belongs to one checkpoint."""
    return (steps.writeStream.outputMode("update").foreachBatch(lambda batch, epoch: publish_monitor(batch, epoch, out_path, expire))
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_monitor(spark, out_path: str) -> DataFrame:
    """The per-run table of the last complete micro-batch."""
    last = spark.read.parquet(f"{out_path}/commits").agg(F.max("epoch")).first()[0]
    opened = spark.read.parquet(f"{out_path}/open/epoch={last}")
    closed = spark.read.schema(opened.withColumn("epoch", F.lit(0)).schema).parquet(f"{out_path}/closed").where(F.col("epoch") <= last).drop("epoch")
    return _totals(opened.unionByName(closed)).drop("last_time")
