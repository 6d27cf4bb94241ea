"""Helpers shared by the operators: tables, shared-folder tables, worker state."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import checkpoint_dir

#: Word of the contracts: a run of characters other than ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bytes of text handed on in one Arrow batch.
BATCH_BYTES = 2 << 20
#: Whether Spark deletes an execution's shuffle files at its end; else they stay until the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: The folders of the tables that ``materialise`` wrote, while their DataFrames are held.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialise(df: DataFrame, what: str, last_use_of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Cuts lineage: written once as Parquet to the shared folder, read back.

    ``last_use_of``: earlier tables of this function that no plan reads once this one is written.
    Void columns and duplicate names do not occur: callers select first."""
    path = shared_folder(df.sparkSession, what)
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")      # nothing reads the shuffles of this write again
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    release(*last_use_of)
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``materialise`` wrote. What was made from them must be written already: a lost
    executor makes Spark read again whatever a plan still names."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop(table))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def worker_state(key, build: Callable):
    """An object built once per Python worker process and kept between tasks.

    Functions travel by value, so a module global would be new in each task;
    the store is a module entry of the process itself."""
    store = sys.modules.setdefault("_millrace_worker_state", types.ModuleType("_millrace_worker_state")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, for ``mapInArrow``: batches of its session hold some ``BATCH_BYTES`` from here on, however long
    the rows are. Spark's default lets one grow to 64 MB, which JVM and worker hold once or twice per task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * BATCH_BYTES))
    return df


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``max_bytes`` of ``column`` (one row at least).

    What Arrow's allocator holds on to afterwards goes back: the worker stays, idle, beside the next stages."""
    col = batch.column(batch.schema.get_field_index(column))
    start = held = 0
    for i, n in enumerate(pa.compute.binary_length(col).fill_null(0).to_pylist()):
        if held and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def n_buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def as_text(name: str = "text"):
    """The text column as a string, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
