"""Catalog entries for E1-E5 (byte-level BPE) over the ``documents`` train split."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from millrace.config import BPEConfig, SplitConfig
from millrace.operators import bpe
from millrace.plans import tokens as tk
from millrace.plans.catalog import register, table
from millrace.session import checkpoint_dir

SPLIT = SplitConfig(val_fraction=0.05, seed=42)
BPE = BPEConfig(vocab_size=16_000, min_frequency=2)

def _train_texts(spark, sf):
    return tk.split_docs(table(spark, sf, "documents"), SPLIT).where(F.col("split") == "train")


def _model(spark, sf, reuse=True):
    """E3 in the application's shared folder: E4 and E5 load what E2 has saved there, or train."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/bpe-{hashlib.md5(f'{sf}|{BPE}'.encode()).hexdigest()}"
    return bpe.load_or_train(spark, path, bpe.pretoken_counts(_train_texts(spark, sf), "text_x", BPE), BPE, reuse)


@register("e1_pretoken_counts")
def q_e1(spark, sf):
    return bpe.pretoken_counts(_train_texts(spark, sf), "text_x", BPE)


@register("e2_train_bpe")
def q_e2(spark, sf):
    return _model(spark, sf, reuse=False).merges


@register("e3_load_or_train")
def q_e3(spark, sf):
    """The vocabulary as saved by training, loaded without anything to train on."""
    _model(spark, sf)
    path = f"{checkpoint_dir(spark).rstrip('/')}/bpe-{hashlib.md5(f'{sf}|{BPE}'.encode()).hexdigest()}"
    return bpe.load_or_train(spark, path, None, BPE).vocab


@register("e4_encode_bpe")
def q_e4b(spark, sf):
    docs = tk.split_docs(table(spark, sf, "documents"), SPLIT)
    enc = bpe.encode(docs, _model(spark, sf), BPE, "text_x", ("doc_id",))
    return enc.select("doc_id", F.size("ids").alias("n_ids"), F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@register("e5_decode_roundtrip", "SELECT doc_id, true AS roundtrip_ok FROM documents")
def q_e5(spark, sf):
    docs = tk.split_docs(table(spark, sf, "documents"), SPLIT)
    model = _model(spark, sf)
    enc = bpe.encode(docs, model, BPE, "text_x", ("doc_id",), append_eos=True)
    dec = bpe.decode(enc, model, ("doc_id",), cfg=BPE)
    expect = F.when(F.col("text_x").startswith(" "), F.col("text_x")).otherwise(F.concat(F.lit(" "), F.col("text_x")))
    return docs.join(dec, "doc_id", "left").select("doc_id", (F.col("text") == expect).alias("roundtrip_ok"))
