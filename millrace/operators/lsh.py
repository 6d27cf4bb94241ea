"""D3 band keys, D4 bucket sizing, D5 candidate pairs.

Buckets are global (two ids meet iff they share a band key), not local to an
input batch. Each bucket emits a star from its smallest id: one pair per
further member whatever the bucket's size, with the same connected components
as all its pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import LSHConfig
from millrace.session import cut_lineage


def band_keys(df: DataFrame, cfg: LSHConfig = LSHConfig(), id_col: str = "id") -> DataFrame:
    """D3: ``(id, band, key)``, ``key = md5(",".join(sig[band*r : band*r+r]))``.

    Only ``sig_ok`` rows whose signature has length ``k`` take part.
    """
    if cfg.k % cfg.b != 0:
        raise ValueError("k must be a multiple of b")
    r = cfg.k // cfg.b
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(cfg.b - 1)),
        lambda j: F.md5(F.array_join(F.transform(F.slice(F.col("sig"), j * r + 1, r), lambda v: v.cast("string")), ",")),
    )
    ok = F.coalesce(F.col("sig_ok"), F.lit(True)) & (F.size("sig") == cfg.k)
    return (df.where(ok)
              .select(F.col(id_col).cast("string").alias("id"), F.posexplode(keys).alias("band", "key")))


def bucket_stats(bands: DataFrame) -> DataFrame:
    """Size and smallest id of every shared bucket (size >= 2).

    A plain aggregate, so Spark combines map-side before the shuffle and a hot
    bucket costs no more than a cold one.
    """
    return (bands.groupBy("band", "key")
                 .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("center"))
                 .where(F.col("n") >= 2))


def candidate_pairs(bands: DataFrame) -> DataFrame:
    """Distinct ``(id1, id2)``, ``id1 < id2`` (string order), of every
    shared bucket's smallest id with each other member.

    The band table feeds both the centers and the member join, so it is
    materialised once (reliable checkpoint) instead of re-running MinHash."""
    bands = cut_lineage(bands)
    centers = bucket_stats(bands).select("band", "key", "center")
    star = bands.join(centers, ["band", "key"]).where(F.col("id") != F.col("center"))   # AQE splits a skewed bucket
    return star.select(F.col("center").alias("id1"), F.col("id").alias("id2")).distinct()
