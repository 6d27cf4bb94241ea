"""D7 attach clusters, D8 pick representative, D9 snapshot, D10 summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.config import SnapshotConfig


def _str_or_empty(df: DataFrame, name: str):
    if name in df.columns:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))
    return F.lit("")


def attach_clusters(rows: DataFrame, cmap: DataFrame) -> DataFrame:
    """Left join on ``id``; ids without a cluster get ``md5(str(id))``."""
    joined = rows.join(cmap.select("id", F.col("cluster_id").alias("_cid")), "id", "left")
    own = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("None")))
    return joined.withColumn("cluster_id", F.coalesce(F.nullif(F.col("_cid"), F.lit("")), own)).drop("_cid")


def pick_representative(df: DataFrame, key_col: str) -> DataFrame:
    """Per non-empty key keep the row with the longest ``code_ref``, then
    the longest ``instruction``, then the smallest ``md5(id)``, then the
    smallest hash of the row.

    The winner is chosen on lengths and hashes alone: one aggregate over narrow
    rows, folded map-side, so a key holding a third of all rows is no hot
    group. Whole rows move once, to meet their key's winner; rows that are equal
    in all of that (copies of one row) are settled where they are then.
    """
    order = [(-F.length(_str_or_empty(df, "code_ref"))).alias("_k1"), (-F.length(_str_or_empty(df, "instruction"))).alias("_k2"),
             F.md5(_str_or_empty(df, "id")).alias("_k3"), F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind]).alias("_k4")]
    names = ["_k1", "_k2", "_k3", "_k4"]
    keyed = df.where(F.col(key_col).isNotNull() & (F.col(key_col).cast("string") != "")).select("*", *order)
    best = keyed.groupBy(F.col(key_col).alias("_key")).agg(F.min(F.struct(*names)).alias("_best"))
    best = best.select("_key", *[F.col("_best")[n].alias(f"_b{n}") for n in names])
    same = keyed[key_col] == best["_key"]
    for n in names:
        same = same & (keyed[n] == best[f"_b{n}"])
    won = keyed.join(best, same)
    one = Window.partitionBy(key_col, *names).orderBy(F.lit(1))
    return won.withColumn("_copy", F.row_number().over(one)).where("_copy = 1").select(*df.columns)


def cluster_snapshot(rows: DataFrame, cmap: DataFrame, cfg: SnapshotConfig = SnapshotConfig()) -> DataFrame:
    """D7-D9 in one pass over the rows: the winners are chosen on ids, lengths
    and hashes alone, then one join by id drops the others and attaches the
    cluster id, so whole rows are shuffled once and no text enters an aggregate.

    Equals ``snapshot(attach_clusters(rows, cmap))``. Rows that share an id
    are settled by ``pick_representative`` among themselves."""
    narrow = rows.select("id", F.length(_str_or_empty(rows, "code_ref")).alias("n1"), F.length(_str_or_empty(rows, "instruction")).alias("n2"))
    per_id = narrow.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("n1", "n2")).alias("longest"))
    own = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("None")))
    per_id = per_id.join(cmap.select(F.col("id").alias("c_id"), F.nullif(F.col("cluster_id"), F.lit("")).alias("_cid")),
                         F.col("id") == F.col("c_id"), "left")
    order = F.struct((-F.col("longest.n1")).alias("k1"), (-F.col("longest.n2")).alias("k2"),
                     F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("k3"))
    per_id = per_id.select(F.col("id").alias("_id"), "_n", F.coalesce("_cid", own).alias("_cluster"), order.alias("_order"), F.col("_cid").isNotNull().alias("_linked"))
    best = per_id.where("_linked").groupBy("_cluster").agg(F.min("_order").alias("_best")).withColumnRenamed("_cluster", "_b_cluster")
    flags = (per_id.join(best, F.col("_linked") & (F.col("_cluster") == F.col("_b_cluster")), "left")
                   .where(F.col("_best").isNull() | (F.col("_order") == F.col("_best"))).select("_id", "_n", "_cluster"))
    kept = rows.drop("cluster_id").join(flags, F.col("id").eqNullSafe(F.col("_id"))).withColumn("cluster_id", F.col("_cluster"))
    names = [*[c for c in rows.columns if c != "cluster_id"], "cluster_id"]
    single = kept.where("_n = 1").select(*names)
    shared = pick_representative(kept.where("_n > 1").select(*names), "cluster_id")
    return single.unionByName(shared).select(*[c for c in cfg.keep_cols if c in names])


def snapshot(rows_with_clusters: DataFrame, cfg: SnapshotConfig = SnapshotConfig()) -> DataFrame:
    """Representatives by ``canon_hash`` (exact) or ``cluster_id``."""
    if cfg.mode not in ("exact", "cluster"):
        raise ValueError("mode must be 'exact' or 'cluster'")
    key = cfg.key_col or ("canon_hash" if cfg.mode == "exact" else "cluster_id")
    reps = pick_representative(rows_with_clusters, key)
    return reps.select(*[c for c in cfg.keep_cols if c in reps.columns])


def cluster_size_histogram(rows_with_clusters: DataFrame) -> DataFrame:
    """``(cluster_size, n_clusters)``."""
    sizes = rows_with_clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    return sizes.groupBy("cluster_size").agg(F.count(F.lit(1)).alias("n_clusters"))


def dedup_summary(rows_with_clusters: DataFrame, pairs: DataFrame, cmap: DataFrame) -> DataFrame:
    """``(metric, value)`` rows; every figure is an aggregate, and each table is read once."""
    def figures(df, **exprs):
        row = df.agg(*[e.cast("bigint").alias(n) for n, e in exprs.items()])
        return row.select(F.stack(F.lit(len(exprs)), *[x for n in exprs for x in (F.lit(n), F.col(n))]).alias("metric", "value"))

    return (figures(rows_with_clusters, rows=F.count(F.lit(1)), kept_rows=F.count_distinct("cluster_id"))
            .unionByName(figures(pairs, pairs=F.count(F.lit(1))))
            .unionByName(figures(cmap, clustered_ids=F.count(F.lit(1)), clusters=F.count_distinct("cluster_id"))))
