"""The registered queries of this subpackage: thin bindings to the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing
from millrace.llm.common import documents, labels, pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_token_counts(spark, sf_dir):
    from millrace.llm.token_counts import token_counts
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op7_byte_bpe(spark, sf_dir):
    from millrace.llm.byte_bpe import round_trip
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op8_mixing(spark, sf_dir):
    from millrace.llm.mixing import mix, quality_weights
    return mix(documents(spark, sf_dir), quality_weights(labels(spark, sf_dir)))


ORACLES["op8_mixing"] = mixing.ORACLE


@_query
def op9_warc(spark, sf_dir):
    from millrace.llm.warc import round_trip
    return round_trip(pages(spark, sf_dir)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op3_syncmer_fingerprints(spark, sf_dir):
    from millrace.llm.syncmers import edited_fingerprints
    return edited_fingerprints(documents(spark, sf_dir))


@_query
def op4_quality_rules(spark, sf_dir):
    from millrace.llm.quality import quality_report
    return quality_report(documents(spark, sf_dir), labels(spark, sf_dir))


@_query
def op2_ngram_join(spark, sf_dir):
    from millrace.llm.ngram_join import near_duplicates
    return near_duplicates(documents(spark, sf_dir), width=4, num=85, den=100)


@_query
def op10_chunk_dedup(spark, sf_dir):
    from millrace.llm.chunk_dedup import whole_passages
    return whole_passages(documents(spark, sf_dir)).drop("text_hash")


@_query
def op6_line_dedup(spark, sf_dir):
    from millrace.llm.line_dedup import TIERS, dedup_lines
    rows = dedup_lines(documents(spark, sf_dir), tiers=TIERS)
    return rows.select("doc_id", rows["__n_lines"].alias("n_lines"), rows["__n_removed"].alias("n_removed"), "text")


@_query
def op5_id_files(spark, sf_dir):
    from millrace.llm.id_files import round_trip
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op12_conversation_repair(spark, sf_dir):
    from millrace.llm.conversation_repair import repair_damaged
    return repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@_query
def op13_collocations(spark, sf_dir):
    from millrace.llm.collocations import collocations
    return collocations(documents(spark, sf_dir))


@_query
def op11_lsh_forest(spark, sf_dir):
    from millrace.llm.lsh_forest import near_duplicates
    return near_duplicates(documents(spark, sf_dir), width=4)
