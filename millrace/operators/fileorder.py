"""B2 and B9 by file order: positions from file metadata, no sort of rows.

A row's place is its file and its number in it. Files are listed once with
their row counts (one row per file; the scan reads no column), ordered by path
or by a seeded hash, and their running sums come from E0; a row's position is
its file's start plus its number. So prefix samples touch the first files
only, and a shuffle of files moves no row.

The buffer shuffle is the bounded one of streaming readers: row ``i`` is dealt
the key ``i + floor(u * buffer)`` with ``u`` from a hash of (seed, i), so no
row passes one that is ``buffer`` or more places away, and a task needs its
own neighbourhood of the order only. Orders are hashes, not an RNG's.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.hashing import unit_interval
from millrace.operators.position import global_positions
from millrace.session import cut_lineage

#: What each role adds to the seed.
ROLE_OFFSET = {"train": 1, "val": 2, "test": 3}
#: Files that are listed in a filter or broadcast at most; beyond it, a join.
LISTED_FILES, BROADCAST_FILES = 1_000, 100_000


def role_seed(seed: int, role: str) -> int:
    return seed + ROLE_OFFSET[role]


def _path_part(uri: Column) -> Column:
    """A file URI's path: without scheme and host, escapes resolved."""
    return F.url_decode(F.replace(F.regexp_replace(uri, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))


def read_placed(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None, glob: str | None = None,
                recursive: bool = False) -> DataFrame:
    """The rows of all files under ``path``, with ``file`` (path below ``path``), ``row`` (number in the
    file, from 0) and ``file_uri``. Parquet numbers its rows; rows of other formats are numbered by
    (split, order of reading), which writes them once. ``recursive`` takes any folders below, not as
    partition columns. No file is an error of the reader."""
    r = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = (r.schema(schema) if schema is not None else r).format(fmt).load(path)
    root = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/")
    whole = _path_part(F.col("_metadata.file_path"))
    inner = F.when(F.startswith(whole, F.lit(root + "/")), F.substring(whole, F.lit(len(root) + 2), F.length(whole))).otherwise(whole)
    placed = df.select("*", inner.alias("file"), F.col("_metadata.file_path").alias("file_uri"),
                       *([F.col("_metadata.row_index").alias("row")] if fmt == "parquet" else [F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__read")]))
    if fmt == "parquet":
        return placed
    return global_positions(placed, ["__start", "__read"], group_cols=["file"], pos_col="row").drop("cum_before", "__start", "__read")


def by_path(file: Column) -> Column:
    """Paths in order of their parts, as a directory walk sorted by path has them."""
    return F.split(file, "/")


def by_hash(seed: int) -> Callable[[Column], Column]:
    """Files in an order shuffled by ``seed``."""
    return lambda file: F.array(F.md5(F.concat(F.lit(f"{seed}:"), file)), file)


def file_starts(placed: DataFrame, order: Callable[[Column], Column] = by_path) -> DataFrame:
    """``(file, file_uri, n, start)``: row counts and positions of first rows, a row per file."""
    files = placed.groupBy("file", "file_uri").agg((F.max("row") + 1).alias("n")).withColumn("__order", order(F.col("file")))
    return cut_lineage(global_positions(files, ["__order", "file"], weight="n").select("file", "file_uri", "n", F.col("cum_before").alias("start")))


def file_positions(placed: DataFrame, order: Callable[[Column], Column] = by_path, pos_col: str = "pos") -> DataFrame:
    """``placed`` with each row's position over all files in ``order``."""
    starts = file_starts(placed, order).select(F.col("file_uri").alias("__uri"), "start")
    if starts.count() <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    return placed.join(starts, F.col("file_uri") == F.col("__uri")).withColumn(pos_col, F.col("start") + F.col("row")).drop("__uri", "start")


def file_prefix_samples(placed: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """B2 in file order: nested samples of the first rows, with ``sample_size`` and ``rank`` (from 1).
    Only files that hold them are read. A size beyond all rows gives all of them and a warning; no row
    at all is an error."""
    sizes = sorted({int(s) for s in sizes})
    starts = file_starts(placed)
    total = starts.agg(F.sum("n")).first()[0]
    if not total:
        raise ValueError("no rows to sample in the files")
    for s in sizes:
        if s > total:
            warnings.warn(f"only {total} rows for a sample of {s}", stacklevel=2)
    needed = starts.where(F.col("start") < sizes[-1]).select(F.col("file_uri").alias("__uri"), "start")
    listed = needed.limit(LISTED_FILES + 1).collect()
    rows = placed.where(F.col("row") < sizes[-1])
    if len(listed) <= LISTED_FILES:      # the filter on the file's name prunes the scan
        rows, needed = rows.where(F.col("file_uri").isin([r["__uri"] for r in listed])), F.broadcast(needed)
    rank = F.col("start") + F.col("row") + 1
    found = rows.join(needed, F.col("file_uri") == F.col("__uri")).withColumn("rank", rank).drop("__uri", "start")
    return found.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("sample_size")).where(F.col("rank") <= F.col("sample_size"))


def buffer_shuffle(df_with_pos: DataFrame, seed: int, buffer: int, pos_col: str = "pos", out_col: str = "shuffled_pos") -> DataFrame:
    """B9 with a bounded buffer: adds the position after a shuffle in which no row overtakes one
    ``buffer`` or more places before it. ``buffer`` of 0 or 1 keeps the order."""
    key = F.concat(F.lit(f"{seed}:"), F.col(pos_col).cast("string"))
    ahead = F.least(F.floor(unit_interval(F.col(pos_col), seed) * max(buffer, 1)).cast("bigint"), F.lit(max(buffer, 1) - 1))
    dealt = df_with_pos.withColumn("__dealt", F.col(pos_col) + ahead).withColumn("__tie", F.md5(key))
    return global_positions(dealt, ["__dealt", "__tie", pos_col], pos_col=out_col).drop("__dealt", "__tie", "cum_before")
