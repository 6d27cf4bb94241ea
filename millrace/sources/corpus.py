"""Corpus readers, stage sinks, run manifest, CSV tables."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.session import checkpoint_dir, spread


def read_parquet_corpus(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                        schema: StructType | None = None) -> DataFrame:
    """A1: Parquet directory (column list pruned at the scan)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.parquet(path)
    return df.select(*columns) if columns else df


def read_jsonl_corpus(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A2: JSON lines (plain or ``.gz``) found recursively; blank lines are
    skipped, a malformed line fails the job, no file at all is an error.
    Gzip files do not split, so the result is spread over the cluster."""
    df = (spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", "true")
               .option("pathGlobFilter", "*.json*").json(path))
    if not df.inputFiles():
        raise FileNotFoundError(f"no JSON lines files under {path}")
    return spread(df)


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A3: one row per line, column ``text``."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def jsonl_to_parquet(spark: SparkSession, src: str, dst: str, schema: StructType | str,
                     columns: Sequence[str] = ("text",)) -> DataFrame:
    """A4: convert, keeping only the text column(s)."""
    read_jsonl_corpus(spark, src, schema).select(*columns).write.mode("overwrite").parquet(dst)
    return spark.read.parquet(dst)


def write_stage(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> DataFrame:
    """Persist a stage and continue from the written copy, so later
    stages never recompute it and the lineage is cut."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder inside the cluster's shared checkpoint location."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def observed_write(df: DataFrame, path: str, name: str = "stage") -> tuple[DataFrame, dict]:
    """Write a stage while counting rows and seconds in the same job."""
    obs = Observation(name)
    t0 = time.time()
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    metrics = {"stage": name, "rows_processed": obs.get["rows"], "wall_time_sec": round(time.time() - t0, 3)}
    return df.sparkSession.read.parquet(path), metrics


def write_manifest(spark: SparkSession, path: str, run_id: str, status: str, started: float,
                   stages: list[dict], artifacts: dict | None = None, stats: dict | None = None) -> DataFrame:
    """One-row JSON manifest (run id, status, times, artifacts, stats,
    per-stage metrics)."""
    row = {"run_id": run_id, "status": status,
           "started_at": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(started)),
           "finished_at": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime()),
           "elapsed_sec": round(time.time() - started, 3),
           "artifacts": json.dumps(artifacts or {}), "stats": json.dumps(stats or {}),
           "stages": json.dumps(stages)}
    df = spark.createDataFrame([row])
    df.coalesce(1).write.mode("overwrite").json(path)
    return spark.read.json(path)


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV or TSV (by extension) with a header."""
    sep = "\t" if path.lower().endswith(".tsv") else ","
    r = spark.read.option("header", "true").option("sep", sep)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", "true")
    return r.csv(path)


def write_table(df: DataFrame, path: str, sort_cols: Sequence[str] = (), sep: str = ",") -> None:
    """Sorted CSV export (the spreadsheet format is replaced by CSV)."""
    out = df.orderBy(*sort_cols) if sort_cols else df
    out.write.mode("overwrite").option("header", "true").option("sep", sep).csv(path)
