"""Catalog entries for D12 (quality), ST1/ST2 (streaming) and A* (sources and
sinks). Round trips write into the cluster's shared checkpoint folder and
read back, so each check covers the writer and the reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.config import SplitConfig
from millrace.functions.text import SQL_WORDS, sql_py_strip
from millrace.operators import quality as ql
from millrace.operators import runlog as rl
from millrace.operators import shards as sh
from millrace.plans import catalog_runlog as crl
from millrace.plans import catalog_tokens as ct
from millrace.plans import dedup as dd
from millrace.plans import oracle_dedup as od
from millrace.plans import runlog as rb
from millrace.plans import tokens as tk
from millrace.plans.catalog import register, table
from millrace.sources import corpus as cs
from millrace.sources import tokenshards as ts
from millrace.streaming import streams as st

SPLIT = SplitConfig(val_fraction=0.05, seed=42)

_LINES = (f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: {sql_py_strip('s')}), "
          "lambda s: s <> '')")
_FEATURES = f"""
feat AS (SELECT d.doc_id, d.lang, d.source, CAST(len({SQL_WORDS.format(t="coalesce(text, '')")}) AS INTEGER) AS n_words,
                CAST(floor(1000 * length(regexp_replace(coalesce(text, ''), '[^\\p{{L}}]', '', 'g'))
                     / greatest(length(coalesce(text, '')), 1)) AS INTEGER) AS alpha_per_mille,
                CAST(floor(1000 * (len({_LINES}) - len(list_distinct({_LINES}))) / greatest(len({_LINES}), 1)) AS INTEGER)
                     AS dup_line_per_mille, l.quality, l.toxic
         FROM documents d LEFT JOIN labels l USING (doc_id)),
fk AS (SELECT *, n_words >= 50 AND alpha_per_mille >= 600 AND dup_line_per_mille <= 300
                 AND coalesce(toxic, 0) = 0 AS keep FROM feat)
"""


def _features(spark, sf):
    return ql.quality_features(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("d12_quality_features", "WITH " + _FEATURES.strip() +
          "\nSELECT doc_id, n_words, alpha_per_mille, dup_line_per_mille, keep FROM fk")
def q_d12f(spark, sf):
    return _features(spark, sf).select("doc_id", "n_words", "alpha_per_mille", "dup_line_per_mille", "keep")


@register("d12_quality_report", "WITH " + _FEATURES.strip() +
          "\nSELECT lang, source, count(*) AS docs, CAST(sum(CAST(keep AS INTEGER)) AS BIGINT) AS kept, "
          "count(quality) AS labeled, CAST(sum(coalesce(quality, 0)) AS BIGINT) AS good, "
          "CAST(sum(coalesce(toxic, 0)) AS BIGINT) AS toxic, CAST(sum(n_words) AS BIGINT) AS words "
          "FROM fk GROUP BY lang, source")
def q_d12(spark, sf):
    return ql.quality_report(_features(spark, sf))


# ---------------------------------------------------------------- streaming

@register("st1_ingest_stream",
          f"SELECT doc_id, text_x, split FROM (SELECT doc_id, {ct._text_x('text')} AS text_x, "
          f"{ct._split_case('doc_id')} AS split FROM documents) q WHERE text_x IS NOT NULL")
def q_st1(spark, sf):
    schema = table(spark, sf, "documents").schema
    stream = st.read_table_landing(spark, sf, "documents", schema)
    out, ckpt = cs.scratch_path(spark, "st1-out"), cs.scratch_path(spark, "st1-ckpt")
    st.ingest_stream(stream, out, ckpt, SPLIT, key_col="doc_id").awaitTermination()
    return spark.read.parquet(out).select("doc_id", "text_x", "split")


@register("st2_monitor_stream", crl._with(
    "SELECT run_id, max(step) AS last_step, min(val_loss) AS best_val_loss, CAST(sum(tokens) AS BIGINT) AS tokens_seen, "
    "bool_or(train_loss IS NOT NULL AND (isnan(train_loss) OR isinf(train_loss))) AS had_nan FROM st GROUP BY run_id"))
def q_st2(spark, sf):
    schema = table(spark, sf, "events").schema
    steps = rb.steps(st.read_table_landing(spark, sf, "events", schema))
    out, ckpt = cs.scratch_path(spark, "st2-out"), cs.scratch_path(spark, "st2-ckpt")
    st.monitor_stream(steps, out, ckpt, expire="7 days").awaitTermination()
    return st.latest_monitor(spark, out)


# ---------------------------------------------------------- sources / sinks

@register("a1_read_parquet", "SELECT doc_id, text FROM documents")
def q_a1(spark, sf):
    return cs.read_parquet_corpus(spark, f"{sf}/documents.parquet", ["doc_id", "text"])


def _jsonl(spark, sf):
    path = cs.scratch_path(spark, "a2-jsonl")
    table(spark, sf, "documents").select("doc_id", "text").write.option("compression", "gzip").json(path)
    return path


@register("a2_read_jsonl", "SELECT doc_id, text FROM documents")
def q_a2(spark, sf):
    return cs.read_jsonl_corpus(spark, _jsonl(spark, sf), "doc_id bigint, text string")


@register("a3_read_text", "SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents")
def q_a3(spark, sf):
    path = cs.scratch_path(spark, "a3-text")
    table(spark, sf, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.text(path)
    return cs.read_text_corpus(spark, path)


@register("a4_jsonl_to_parquet", "SELECT text FROM documents")
def q_a4(spark, sf):
    return cs.jsonl_to_parquet(spark, _jsonl(spark, sf), cs.scratch_path(spark, "a4-parquet"),
                               "doc_id bigint, text string")


@register("a6_stage_roundtrip", od.with_chain("SELECT id1, id2 FROM pairs"))
def q_a6(spark, sf):
    return cs.write_stage(dd.pairs(table(spark, sf, "documents")), cs.scratch_path(spark, "a6-pairs"))


@register("a7_token_shards_roundtrip", ct._with(
    "SELECT o.split, CAST(w.shard AS INTEGER) AS shard, CAST(sum(len(o.ids)) AS BIGINT) AS n_tokens, "
    "CAST(sum(list_sum(o.ids)) AS BIGINT) AS token_sum FROM ord o JOIN walk w USING (split, pos) GROUP BY o.split, w.shard",
    ct._SHARD_WALK))
def q_a7(spark, sf):
    e = tk.encoded_docs(table(spark, sf, "documents"), SPLIT).withColumn("nbytes", F.size("ids") * 2)
    shards = sh.assign_shards(e, ["doc_id"], "nbytes", ct.SHARD_BYTES).withColumnRenamed("ids", "tokens")
    path = cs.scratch_path(spark, "a7-bin")
    ts.write_raw_shards(shards, path, "uint16")
    back = ts.read_raw_shards(spark, path, "uint16")
    return back.groupBy("split", "shard").agg(
        F.sum(F.size("tokens")).cast("bigint").alias("n_tokens"),
        F.sum(F.aggregate("tokens", F.lit(0).cast("bigint"), lambda acc, x: acc + x)).cast("bigint").alias("token_sum"))


@register("a8_run_manifest", od.with_chain(
    "SELECT 'run-a8' AS run_id, 'finished' AS status, 'pairs' AS stage, count(*) AS rows_processed, count(*) AS counted FROM pairs"))
def q_a8(spark, sf):
    """The manifest without its times, read back from where it was written."""
    import time
    t0 = time.time()
    out, metrics = cs.observed_write(dd.pairs(table(spark, sf, "documents")), cs.scratch_path(spark, "a8-pairs"), "pairs")
    written = cs.write_manifest(spark, cs.scratch_path(spark, "a8-manifest"), "run-a8", "finished", t0, [metrics],
                                {"pairs": "written"}, {"pairs": metrics["rows_processed"]})
    stage = F.explode(F.from_json("stages", "array<struct<stage string, rows_processed bigint, wall_time_sec double>>")).alias("s")
    return written.select("run_id", "status", stage, F.get_json_object("stats", "$.pairs").cast("bigint").alias("counted")) \
                  .select("run_id", "status", "s.stage", "s.rows_processed", "counted")


@register("a9_csv_roundtrip",
          "SELECT change, layer, step, round(mult / sqrt(head_dim) * xm * wk, 9) AS sigma_bound_mean FROM "
          f"({crl._DIAG}) d")
def q_a9(spark, sf):
    d = rl.sigma_bounds(rb.part_diagnostics(table(spark, sf, "part"))) \
          .select("change", "layer", "step", F.round("sigma_bound_mean", 9).alias("sigma_bound_mean"))
    path = cs.scratch_path(spark, "a9-csv")
    cs.write_table(d, path, ["change", "layer", "step"])
    return cs.read_table(spark, path, "change string, layer int, step bigint, sigma_bound_mean double")
