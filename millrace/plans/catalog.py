"""Registry of runnable queries over the driver tables and their SQL oracles.

Each query is ``f(spark, sf_dir) -> DataFrame`` reading whole tables; each
oracle is DuckDB SQL over the same tables with the same column names.
Queries whose semantics SQL cannot state (iterative training, stateful
streams, Python AST work) have no oracle and are checked by tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans import dedup as dd
from millrace.plans import oracle_dedup as od
from millrace.config import MinHashConfig, SnapshotConfig
from millrace.operators.components import cluster_map
from millrace.operators.snapshot import cluster_size_histogram, dedup_summary, snapshot
from millrace.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dd.read_table(spark, sf_dir, name)


# ---------------------------------------------------------------- dedup (D*)

@register("d1_shingles", od.with_chain(
    "SELECT d.id, CAST(len(d.t) AS BIGINT) AS n_tokens, CAST(coalesce(len(sh.s), 0) AS BIGINT) AS n_shingles "
    "FROM docs d LEFT JOIN sh USING (id)"))
def q_d1(spark, sf):
    from millrace.operators.minhash import shingles
    t = dd.document_tokens(table(spark, sf, "documents"))
    return t.select("id", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.size(shingles(F.col("tokens"), 5)).cast("bigint").alias("n_shingles"))


@register("d2_minhash", od.with_chain(
    "SELECT id, true AS sig_ok, string_agg(CAST(m AS VARCHAR), ',' ORDER BY i) AS sig FROM sig GROUP BY id"))
def q_d2(spark, sf):
    s = dd.signatures(table(spark, sf, "documents"))
    return s.where("sig_ok").select("id", "sig_ok", F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))


@register("d2_minhash_xxhash64")
def q_d2x(spark, sf):
    """The 64-bit family, for which DuckDB has no hash; a test holds it against the public xxhash library."""
    s = dd.signatures(table(spark, sf, "documents"), dd.DedupConfig(minhash=MinHashConfig(hash_family="xxhash64", num_perm=16)))
    return s.where("sig_ok").select("id", "sig_ok", F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))


@register("d3_band_keys", od.with_chain("SELECT id, band, key FROM band"))
def q_d3(spark, sf):
    return dd.bands(table(spark, sf, "documents"))


@register("d4_buckets", od.with_chain("SELECT band, key, n, center FROM stats"))
def q_d4(spark, sf):
    return dd.buckets(table(spark, sf, "documents"))


@register("d5_candidate_pairs", od.with_chain("SELECT id1, id2 FROM pairs"))
def q_d5(spark, sf):
    return dd.pairs(table(spark, sf, "documents"))


@register("d6_cluster_map", od.with_chain("SELECT id, cluster_id FROM cmap"))
def q_d6(spark, sf):
    return dd.clusters(table(spark, sf, "documents"))


@register("d7_attach_clusters", od.with_chain("SELECT id, cluster_id FROM rws"))
def q_d7(spark, sf):
    return dd.rows_with_clusters(table(spark, sf, "documents")).select("id", "cluster_id")


@register("d9_snapshot", od.with_chain(od.SNAPSHOT_SELECT))
def q_d9(spark, sf):
    return dd.dedup_documents(table(spark, sf, "documents"))


@register("d9_snapshot_exact", """
SELECT dataset, id, instruction, code_ref, language, has_code, canon_hash FROM (
  SELECT source AS dataset, CAST(doc_id AS VARCHAR) AS id, lang AS instruction, text AS code_ref, 'text' AS language,
         true AS has_code, md5(text) AS canon_hash,
         row_number() OVER (PARTITION BY md5(text) ORDER BY length(coalesce(lang, '')) DESC, md5(CAST(doc_id AS VARCHAR))) AS rn
  FROM documents) q WHERE rn = 1
""")
def q_d9x(spark, sf):
    """Exact mode, with a hash of the text as the key."""
    rows = dd.document_rows(table(spark, sf, "documents")).withColumn("canon_hash", F.md5("code_ref"))
    keep = ("dataset", "id", "instruction", "code_ref", "language", "has_code", "canon_hash")
    return snapshot(rows, SnapshotConfig(mode="exact", keep_cols=keep))


@register("d10_cluster_sizes", od.with_chain(
    "SELECT cluster_size, count(*) AS n_clusters FROM "
    "(SELECT cluster_id, count(*) AS cluster_size FROM rws GROUP BY cluster_id) s GROUP BY cluster_size"))
def q_d10(spark, sf):
    return cluster_size_histogram(dd.rows_with_clusters(table(spark, sf, "documents")))


@register("d10_dedup_summary", od.with_chain(
    "SELECT 'rows' AS metric, CAST(count(*) AS BIGINT) AS value FROM rws "
    "UNION ALL SELECT 'kept_rows', CAST(count(DISTINCT cluster_id) AS BIGINT) FROM rws "
    "UNION ALL SELECT 'pairs', CAST(count(*) AS BIGINT) FROM pairs "
    "UNION ALL SELECT 'clustered_ids', CAST(count(*) AS BIGINT) FROM cmap "
    "UNION ALL SELECT 'clusters', CAST(count(DISTINCT cluster_id) AS BIGINT) FROM cmap"))
def q_d10s(spark, sf):
    docs = table(spark, sf, "documents")
    p = cut_lineage(dd.pairs(docs))
    cm = cut_lineage(cluster_map(p))
    return dedup_summary(dd.attach_clusters(dd.document_rows(docs), cm), p, cm)


# Further registries add themselves to QUERIES / ORACLES on import.
from millrace.plans import catalog_tokens  # noqa: E402,F401
from millrace.plans import catalog_runlog  # noqa: E402,F401
from millrace.plans import catalog_code  # noqa: E402,F401
from millrace.plans import catalog_bpe  # noqa: E402,F401
from millrace.plans import catalog_io  # noqa: E402,F401
