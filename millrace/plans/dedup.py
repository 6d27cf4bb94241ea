"""The near-duplicate pipeline: rows -> tokens -> MinHash -> LSH pairs ->
components -> representatives, plus its binding to the ``documents`` table.

Stage outputs can be persisted (``write_stage``) and read back so later
stages never recompute earlier ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import ComponentsConfig, LSHConfig, MinHashConfig, SnapshotConfig
from millrace.functions.text import words
from millrace.operators.components import cluster_map
from millrace.operators.lsh import band_keys, bucket_stats, candidate_pairs
from millrace.operators.minhash import apply_minhash
from millrace.operators.snapshot import attach_clusters, cluster_snapshot
from millrace.session import spread


@dataclass(frozen=True)
class DedupConfig:
    minhash: MinHashConfig = field(default_factory=MinHashConfig)
    lsh: LSHConfig = field(default_factory=LSHConfig)
    components: ComponentsConfig = field(default_factory=ComponentsConfig)
    snapshot: SnapshotConfig = field(default_factory=SnapshotConfig)


def document_rows(docs: DataFrame) -> DataFrame:
    """Binding of ``documents`` to the code-row schema used by the snapshot:
    ``id = str(doc_id)``, ``dataset = source``, ``instruction = lang``,
    ``code_ref = text``; every row is treated as parseable text."""
    return docs.select(
        F.col("source").alias("dataset"),
        F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("instruction"),
        F.col("text").alias("code_ref"),
        F.lit("text").alias("language"),
        F.lit(True).alias("has_code"),
    )


def document_tokens(docs: DataFrame) -> DataFrame:
    """``(id, tokens)``: lower-cased words of the document text."""
    return spread(docs.select(F.col("doc_id").cast("string").alias("id"), "text")).select(
        "id", words("text").alias("tokens"))


def signatures(docs: DataFrame, cfg: DedupConfig = DedupConfig()) -> DataFrame:
    return apply_minhash(document_tokens(docs), "tokens", cfg.minhash).select("id", "sig_ok", "sig")


def bands(docs: DataFrame, cfg: DedupConfig = DedupConfig()) -> DataFrame:
    return band_keys(signatures(docs, cfg), cfg.lsh)


def buckets(docs: DataFrame, cfg: DedupConfig = DedupConfig()) -> DataFrame:
    return bucket_stats(bands(docs, cfg))


def pairs(docs: DataFrame, cfg: DedupConfig = DedupConfig()) -> DataFrame:
    return candidate_pairs(bands(docs, cfg))


def clusters(docs: DataFrame, cfg: DedupConfig = DedupConfig()) -> DataFrame:
    return cluster_map(pairs(docs, cfg), cfg.components)


def rows_with_clusters(docs: DataFrame, cfg: DedupConfig = DedupConfig()) -> DataFrame:
    return attach_clusters(document_rows(docs), clusters(docs, cfg))


def dedup_documents(docs: DataFrame, cfg: DedupConfig = DedupConfig()) -> DataFrame:
    """The deduplicated corpus: one representative per near-duplicate cluster."""
    return cluster_snapshot(document_rows(docs), clusters(docs, cfg), cfg.snapshot)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
