"""Quality features and report (the documented stage; the rules are ours).

Per document: word count, letters per mille of characters, repeated
non-empty lines per mille of non-empty lines, joined with the optional
labels. Integer per-mille values keep the thresholds exact across engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import QualityConfig
from millrace.functions.text import py_strip, words


def quality_features(docs: DataFrame, labels: DataFrame | None = None, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: py_strip(s)), lambda s: s != "")
    out = docs.select(
        "doc_id", "lang", "source",
        F.size(words(text)).alias("n_words"),
        F.floor(F.lit(1000) * letters / F.greatest(F.length(text), F.lit(1))).cast("int").alias("alpha_per_mille"),
        F.floor(F.lit(1000) * (F.size(lines) - F.size(F.array_distinct(lines)))
                / F.greatest(F.size(lines), F.lit(1))).cast("int").alias("dup_line_per_mille"))
    if labels is not None:
        out = out.join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left")
    else:
        out = out.withColumn("quality", F.lit(None).cast("int")).withColumn("toxic", F.lit(None).cast("int"))
    keep = ((F.col("n_words") >= cfg.min_words) & (F.col("alpha_per_mille") >= cfg.min_alpha_per_mille)
            & (F.col("dup_line_per_mille") <= cfg.max_dup_line_per_mille)
            & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
    return out.withColumn("keep", keep)


def quality_report(features: DataFrame) -> DataFrame:
    """Counts per (lang, source)."""
    return features.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.col("keep").cast("int")).cast("bigint").alias("kept"),
        F.count("quality").alias("labeled"),
        F.sum(F.coalesce(F.col("quality"), F.lit(0))).cast("bigint").alias("good"),
        F.sum(F.coalesce(F.col("toxic"), F.lit(0))).cast("bigint").alias("toxic"),
        F.sum("n_words").cast("bigint").alias("words"))
