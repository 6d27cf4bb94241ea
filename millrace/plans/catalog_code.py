"""Catalog entries for C* (canonicalization), code dedup, B3/B4 and D11."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.config import SplitConfig
from millrace.functions.hashing import sql_unit_interval
from millrace.operators import canon as cn
from millrace.operators.rows import filter_parseable
from millrace.operators.split import final_split
from millrace.plans import code as cd
from millrace.plans import dedup as dd
from millrace.plans import oracle_dedup as od
from millrace.plans.catalog import register, table

SPLIT = SplitConfig(val_fraction=0.05, seed=42)


def _summary(df):
    return df.select("id", "parse_ok", "parse_err", F.size("node_types").cast("bigint").alias("n_nodes"))


@register("c1_canonicalize")
def q_c1(spark, sf):
    rows = cn.with_canon_hash(cd.canonical_rows(table(spark, sf, "documents")))
    return rows.select("id", "parse_ok", "parse_err", F.size("node_types").cast("bigint").alias("n_nodes"), "canon_hash")


@register("c2_token_fallback")
def q_c2(spark, sf):
    return _summary(cd.canonical_rows(table(spark, sf, "documents"), on_parse_error="fallback"))


# The parse outcome per row is known from the binding (text rows and rows
# without code are rejected; template 5 has a syntax error).
_EXPECT = ("CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'not_python_or_no_code' "
           "WHEN doc_id % 6 = 5 THEN 'SyntaxError' ELSE '' END")


@register("c4_parse_report",
          f"SELECT err_class = '' AS parse_ok, err_class, count(*) AS rows FROM "
          f"(SELECT {_EXPECT} AS err_class FROM documents) q GROUP BY err_class")
def q_c4(spark, sf):
    return cn.parse_report(cd.canonical_rows(table(spark, sf, "documents")))


@register("b3_filter_parseable",
          f"SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE {_EXPECT} = ''")
def q_b3(spark, sf):
    return filter_parseable(cd.canonical_rows(table(spark, sf, "documents"))).select("id")


@register("b4_filter_sig_ok", od.with_chain("SELECT id FROM sh"))
def q_b4(spark, sf):
    from millrace.operators.rows import filter_sig_ok
    return filter_sig_ok(dd.signatures(table(spark, sf, "documents"))).select("id")


# Rows of one template share a canonical hash; rejected rows have none.
@register("c3_canon_hash", f"SELECT CAST(doc_id % 6 AS BIGINT) AS template, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_hashes "
                           f"FROM documents WHERE {_EXPECT} = '' GROUP BY 1")
def q_c3(spark, sf):
    rows = cn.with_canon_hash(cd.canonical_rows(table(spark, sf, "documents"))).where("canon_hash IS NOT NULL")
    return rows.groupBy(F.pmod(F.col("id").cast("bigint"), F.lit(6)).alias("template")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("canon_hash").alias("n_hashes"))


@register("c_code_dedup_snapshot")
def q_code_snap(spark, sf):
    return cd.code_snapshot(table(spark, sf, "documents")).select("id", "dataset", "language", "has_code", "cluster_id")


@register("d11_final_split", od.with_chain(
    f"SELECT id, cluster_id, CASE WHEN {sql_unit_interval('id', SPLIT.seed)} < {SPLIT.val_fraction} "
    "THEN 'val' ELSE 'train' END AS split FROM (" + od.SNAPSHOT_SELECT + ") s"))
def q_d11(spark, sf):
    snap = dd.dedup_documents(table(spark, sf, "documents"))
    return final_split(snap, SPLIT, key_col="id").select("id", "cluster_id", "split")
