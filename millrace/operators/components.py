"""D6 connected components over an undirected pair table.

Alternating large-star / small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014) as DataFrame aggregates and
joins. Every round is a handful of shuffles over the edge table; the number
of rounds grows with log(component size), not with the diameter, so a
chain of 50 ids does not take 50 rounds. Each round's edges are written with
a reliable checkpoint so the lineage stays short and a lost executor only
recomputes one round.

A centre of more than ``HOT`` edges and a share of all edges is not joined by
shuffle: at most ``8 * partitions`` centres can be that large, so their minima
(aggregated map-side) are broadcast and their edges stay where they are.

Ids are compared as strings; null and empty ids are skipped. The cluster id
is ``md5(smallest id in the component)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import ComponentsConfig
from millrace.session import cut_lineage


def _oriented(pairs: DataFrame, a: str, b: str) -> DataFrame:
    u, v = F.col(a).cast("string"), F.col(b).cast("string")
    good = u.isNotNull() & v.isNotNull() & (u != "") & (v != "") & (u != v)
    return pairs.where(good).select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo")).distinct()


#: Edges of a centre from which on its minimum may be broadcast.
HOT = 50_000


def _with_least(e: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (u, ..) with ``mv``, the smallest ``v`` of ``e`` (u, v; ``n`` rows) for their ``u``."""
    m = e.groupBy("u").agg(F.min("v").alias("mv"), F.count(F.lit(1)).alias("degree"))
    limit = max(HOT, n // (4 * int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if n <= limit:                         # no centre can be above it
        return rows.join(m.drop("degree"), "u")
    hot = F.broadcast(m.where(F.col("degree") > limit).drop("degree"))
    rest = rows.join(hot.select("u"), "u", "left_anti").join(m.where(F.col("degree") <= limit).drop("degree"), "u")
    return rows.join(hot, "u").unionByName(rest)


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    near = _with_least(both, both.where(F.col("v") > F.col("u")), 2 * n)
    return near.select(F.col("v").alias("hi"), F.least("u", "mv").alias("lo")).distinct()


def _small_star(e: DataFrame, n: int) -> DataFrame:
    down = e.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    near = _with_least(down, down, n)
    leaves = near.where(F.col("v") != F.col("mv")).select(F.col("v").alias("hi"), F.col("mv").alias("lo"))
    return leaves.unionByName(e.groupBy("hi").agg(F.min("lo").alias("lo"))).distinct()


def _is_star_forest(e: DataFrame) -> bool:
    """True when every edge is (leaf, centre), each leaf has one centre and no
    centre is a leaf: then each component is a star around its smallest id."""
    multi = e.groupBy("hi").count().where(F.col("count") > 1).limit(1).count()
    if multi:
        return False
    centres = e.select(F.col("lo").alias("hi")).distinct()
    chained = centres.join(e.select("hi"), "hi", "left_semi").limit(1).count()
    return chained == 0


def component_roots(pairs: DataFrame, cfg: ComponentsConfig = ComponentsConfig(),
                    a: str = "id1", b: str = "id2") -> DataFrame:
    """``(id, root)`` for every id seen in a valid pair; root = smallest id."""
    e = cut_lineage(_oriented(pairs, a, b))
    for _ in range(cfg.max_rounds):
        if _is_star_forest(e):
            break
        n = e.count()                      # of a checkpoint
        e = cut_lineage(_small_star(_large_star(e, n), n))
    else:
        raise RuntimeError(f"connected components did not converge in {cfg.max_rounds} rounds")
    centres = e.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct()
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("root")).unionByName(centres)


def cluster_map(pairs: DataFrame, cfg: ComponentsConfig = ComponentsConfig(),
                a: str = "id1", b: str = "id2") -> DataFrame:
    """``(id, cluster_id)``; only ids that occur in pairs appear."""
    return component_roots(pairs, cfg, a, b).select("id", F.md5("root").alias("cluster_id"))
