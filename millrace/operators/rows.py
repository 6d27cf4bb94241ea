"""Row selection, sampling, sharding and batching.

Positions come from E0 (``global_positions``); nothing here orders the
whole corpus in one task. Limits exist only where the cap is the feature
(debug runs, prefix samples, sample caps).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import py_strip
from millrace.operators.position import global_positions


def debug_limit(df: DataFrame, n: int | None, order_cols: Sequence[str] = ()) -> DataFrame:
    """B1: cap rows for a debug run; with ``order_cols`` the cap is
    deterministic (a top-n per partition, then one merge of n rows)."""
    if n is None:
        return df
    return (df.orderBy(*order_cols) if order_cols else df).limit(n)


def prefix_samples(df: DataFrame, sizes: Sequence[int], order_cols: Sequence[str]) -> DataFrame:
    """B2: nested samples; the sample of size s is the first s rows in order,
    so smaller samples are prefixes of larger ones. Adds ``sample_size`` and
    ``rank`` (1-based). Only ``max(sizes)`` rows are ever gathered."""
    top = max(sizes)
    head = df.orderBy(*order_cols).limit(top)
    ranked = head.withColumn("rank", F.row_number().over(Window.orderBy(*order_cols)))  # <= top rows
    size_col = F.explode(F.array(*[F.lit(int(s)) for s in sorted(set(sizes))]))
    return ranked.select("*", size_col.alias("sample_size")).where(F.col("rank") <= F.col("sample_size"))


def filter_parseable(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Keep ``parse_ok`` rows (missing or null counts as false)."""
    if not enabled:
        return df
    if "parse_ok" not in df.columns:
        return df.limit(0)
    return df.where(F.coalesce(F.col("parse_ok"), F.lit(False)))


def filter_sig_ok(df: DataFrame, enabled: bool = True) -> DataFrame:
    """B4."""
    if not enabled:
        return df
    return df.where(F.coalesce(F.col("sig_ok"), F.lit(False)))


def cap_samples(df: DataFrame, n: int | None, order_cols: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in order. Apply before the text/split filter
    for the tokenizer path, after it for the loader path."""
    if n is None:
        return df
    return df.orderBy(*order_cols).limit(n)


def shuffle_key(key: str, seed: int):
    """B9 order key: ``md5(f"{seed}:{key}")`` (tie-break on the key)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def seeded_shuffle(df: DataFrame, key: str, seed: int, pos_col: str = "pos") -> DataFrame:
    """Deterministic permutation; adds the 0-based position in it."""
    keyed = df.withColumn("_shuf", shuffle_key(key, seed))
    return global_positions(keyed, ["_shuf", key], pos_col=pos_col).drop("_shuf", "cum_before")


def extract_sentences(df: DataFrame, text_col: str = "text", order_cols: Sequence[str] = (),
                      cap: int | None = None) -> DataFrame:
    """Split on newline, strip, drop empty lines; optional cap."""
    lines = df.select(*order_cols, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    out = lines.select(*order_cols, "line_no", py_strip("line").alias("sentence")).where(F.col("sentence") != "")
    if cap is not None:
        out = out.orderBy(*order_cols, "line_no").limit(cap)
    return out


def shard_rows(df_with_pos: DataFrame, world_size: int, num_workers: int = 1, pos_col: str = "pos") -> DataFrame:
    """Row ``i`` goes to shard ``i % (world*workers)``, i.e. rank
    ``shard // workers`` and worker ``shard % workers`` — for all ranks at once."""
    n = world_size * max(num_workers, 1)
    shard = F.pmod(F.col(pos_col), F.lit(n))
    return (df_with_pos.withColumn("rank", (shard / max(num_workers, 1)).cast("int"))
                       .withColumn("worker", F.pmod(shard, F.lit(max(num_workers, 1))).cast("int")))


def equal_split(df_with_pos: DataFrame, world_size: int, total_rows: int, pos_col: str = "pos") -> DataFrame:
    """Equal contiguous shards of ``total_rows // world`` rows; the
    remainder is dropped. ``total_rows`` comes from a count of the same
    frame; fewer rows than ranks is an error."""
    if total_rows < world_size:
        raise ValueError(f"{total_rows} rows cannot be split over {world_size} ranks")
    per = total_rows // world_size
    return (df_with_pos.withColumn("rank", F.floor(F.col(pos_col) / per).cast("int"))
                       .where(F.col("rank") < world_size))


def batch_rows(df_with_pos: DataFrame, batch_size: int, drop_last: bool, text_col: str = "text",
               pos_col: str = "pos") -> DataFrame:
    """Fixed-size batches of texts in position order; the incomplete tail
    batch is dropped when ``drop_last`` (train) and kept otherwise (val).
    Each group holds at most ``batch_size`` rows."""
    b = df_with_pos.withColumn("batch", F.floor(F.col(pos_col) / batch_size).cast("bigint"))
    g = b.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(pos_col, text_col))).alias("_rows"))
    out = g.select("batch", F.transform("_rows", lambda r: r[text_col]).alias("texts"),
                   F.size("_rows").alias("batch_rows"))
    if drop_last:
        out = out.where(F.col("batch_rows") == batch_size)
    return out
