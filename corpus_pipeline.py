"""The training-data pipeline: five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept; all but the
last return the columns of ``documents``.

A null or empty text has no words, so the first stage rejects it. Rows without a doc_id are judged by
their texts like others and are never dropped as copies; rows of one doc_id with one text count once where
copies are sought and go or stay together. Null languages and sources are groups of their own. Other
columns, whatever their names, come through unread. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.byte_bpe import round_trip
from millrace.llm.common import documents, labels, materialise
from millrace.llm.line_dedup import dedup_lines
from millrace.llm.mixing import mix, quality_weights
from millrace.llm.ngram_join import one_of_each
from millrace.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or a risk-controlled threshold rejects go."""
    return keep_good(docs, labels(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or nearly equal to an earlier one are taken out of the texts."""
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("bigint"))
    return out.select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, likeness 0.8) the smallest doc_id stays."""
    return one_of_each(docs, width=5, num=80, den=100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources meet their target weights."""
    whole = docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))     # so that no name can clash
    mixed = mix(whole, quality_weights(labels(spark, sf_dir)), keep=("__row",)).where("copies > 0")
    return mixed.select(F.explode(F.sequence(F.lit(1), F.col("copies"))), "__row").select("__row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, ids_sha256, decoded_sha256)`` of each remaining document."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", ngram_join),
          ("mixing sources to target weights", mixing), ("byte-level BPE encoding and decoding", byte_bpe)]

#: Segment joins, near-duplicate components and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over ``documents``; each result is written to the shared folder."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
