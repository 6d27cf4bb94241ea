"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Targets: sources in code-point order (null last) carry the weights in turn and share
``share`` times all words by weight; no target exceeds ``cap`` times its source, the excess
going to the others by weight. With the sources sorted by cap over weight the capped ones
are a prefix, so the final level follows from running sums over the sources.

Selection: whole epochs of a source first, then documents in ascending order of the
exponential key ``-ln(u) / weight`` (``u`` from a hash of seed and id, ``weight`` the
document's quality weight) while the running size is nearer to what is left of the target
with the document than without it. The order is not sorted as a whole: keys fall into
buckets by value, bucket totals find the one bucket per source that the target ends in, and
only that bucket is sorted. A hot source has as many buckets as its rows need.

Rows: one per input row. Null text has size 0 and is taken with size 0; null source is a
source of its own; equal rows have equal keys; a null id hashes as the word null; an empty
table gives an empty result. Rerunning gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import WORD, as_text, materialise

WEIGHTS = (3, 1, 2)
BUCKET_ROWS = 20_000
#: Source rows that are broadcast at most; more of them are joined by shuffle.
BROADCAST_SOURCES = 50_000


def quality_weights(labels: DataFrame, good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """``(doc_id, weight)``; of contradicting labels the better one counts."""
    return (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("q"))
                  .select("doc_id", F.when(F.col("q") > 0, good).when(F.col("q") == 0, bad).otherwise(1.0).alias("weight")))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(source, source_size, n_docs, target)`` from rows of ``(source, size)``."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") * cap / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    per = (per.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
              .withColumn("capped", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
              .withColumn("open_w", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
              .withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.col("capped")) / F.col("open_w")))
    # The first source, in this order, that the level leaves below its cap fixes the level.
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("capped"), F.col("level")))).over(every)
    return per.select("source", "source_size", "n_docs", F.least("cap", F.coalesce(level["level"] * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0,
        seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` and the columns of
    ``docs`` in ``keep`` (a clash with these names goes to the names of this operator)."""
    kept = [c for c in keep if c not in ("doc_id", "source")]
    unit = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.select("doc_id", F.col("source"), F.regexp_count(as_text(), F.lit(WORD)).cast("bigint").alias("size"),
                       (-F.log((F.conv(F.substring(unit, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52))).alias("__key"),
                       *[F.col(c).alias(f"__keep_{c}") for c in kept])
    if quality is not None:
        q = quality.select(F.col("doc_id").alias("__q_id"), F.col("weight").alias("__weight"))
        rows = (rows.join(q, F.col("doc_id") == F.col("__q_id"), "left")
                    .withColumn("__key", F.col("__key") / F.coalesce("__weight", F.lit(1.0))).drop("__q_id", "__weight"))
    rows = materialise(rows, "mix-rows")
    per = materialise(targets(rows, weights, share, cap)
                      .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
                      .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
                      .withColumn("n_buckets", F.ceil(F.col("n_docs") / BUCKET_ROWS).cast("int"))
                      .withColumnRenamed("source", "__source"), "mix-targets")
    few = per.count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda df: df)
    bucket = F.floor((1 - F.exp(-F.col("__key"))) * F.col("n_buckets")).cast("int")
    rows = (rows.join(hint(per), F.col("source").eqNullSafe(F.col("__source")))
                .withColumn("__bucket", F.least(bucket, F.col("n_buckets") - 1)))

    totals = rows.groupBy("__source", "__bucket").agg(F.sum("size").alias("__total"), F.first("rest").alias("__rest"))
    running = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (totals.withColumn("__before", F.coalesce(F.sum("__total").over(running), F.lit(0)))
                  .where((F.col("__before") < F.col("__rest")) & (F.col("__before") + F.col("__total") >= F.col("__rest")))
                  .groupBy(F.col("__source").alias("__end_source"))
                  .agg(F.min("__bucket").alias("__end"), F.min("__before").alias("__before")))
    rows = rows.join(hint(ends), F.col("__source").eqNullSafe(F.col("__end_source")), "left")
    # Without such a bucket nothing is left of the target, or the rest is the whole source up to rounding.
    inside = F.when(F.col("__end").isNull(), F.lit(False)).otherwise(F.col("__bucket") < F.col("__end"))
    within = (Window.partitionBy("__source", "__bucket").orderBy("__key", F.col("doc_id").asc_nulls_last(), "size")
                    .rowsBetween(Window.unboundedPreceding, -1))
    at_end = F.coalesce(F.col("__bucket") == F.col("__end"), F.lit(False))
    sure = rows.where(~at_end).withColumn("__more", inside)
    edge = (rows.where(at_end).withColumn("__at", F.col("__before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
                .withColumn("__more", (F.col("__at") < F.col("rest")) & (F.col("__at") + F.col("size") / 2 <= F.col("rest"))).drop("__at"))
    copies = F.col("epochs") + F.col("__more").cast("int")
    return sure.unionByName(edge).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                                         (copies * F.col("size")).cast("bigint").alias("taken"),
                                         *[F.col(f"__keep_{c}").alias(c) for c in kept])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         -ln((CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
           / coalesce(CASE WHEN q > 0 THEN 2.0 WHEN q = 0 THEN 0.5 END, 1.0) AS k
  FROM documents LEFT JOIN (SELECT doc_id AS qid, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY 1) ON doc_id = qid),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY 1),
w AS (SELECT *, CAST([3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS DOUBLE) AS w, s * 2.0::DOUBLE AS c FROM p),
l AS (SELECT *, sum(c) OVER o - c AS capped, sum(w) OVER (ORDER BY s * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ow,
             (SELECT sum(s) FROM p) * 1.5::DOUBLE AS t
      FROM w WINDOW o AS (ORDER BY s * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v AS (SELECT (t - capped) / ow AS level, capped FROM l WHERE (t - capped) / ow * w <= c ORDER BY capped, level LIMIT 1),
g AS (SELECT source AS src, s, least(c, coalesce((SELECT level FROM v) * w, c)) AS target FROM l),
e AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS epochs FROM g),
r AS (SELECT d.*, s, target, epochs, target - epochs * s AS rest,
             coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN e ON source IS NOT DISTINCT FROM src)
SELECT doc_id, source, size, s AS source_size, target,
       CAST(epochs + CASE WHEN before < rest AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END AS INT) AS copies,
       CAST((epochs + CASE WHEN before < rest AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""
