import json

import pytest
from pyspark.sql import functions as F

from millrace.config import BPEConfig
from millrace.operators import bpe

TEXTS = [
    "The quick brown fox jumps over the lazy dog.",
    "Le renard brun rapide saute par-dessus le chien paresseux; naïve café.",
    "Der schnelle braune Fuchs springt über den faulen Hund!!  Straße 42",
    "the the the  then there these   those\tthat 1234 12 3",
    "El zorro marrón rápido salta sobre el perro perezoso... ¿verdad?",
] * 3


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    cfg = BPEConfig(vocab_size=180, min_frequency=2)
    model = bpe.train_bpe(bpe.pretoken_counts(docs, "text", cfg), cfg)
    return docs, cfg, model


def test_byte_alphabet_is_a_bijection():
    assert len(set(bpe.BYTE_CHARS)) == 256
    assert bpe.BYTE_CHARS[ord("A")] == "A" and bpe.BYTE_CHARS[32] == "Ġ"


def test_merges_match_public_trainer(trained):
    tokenizers = pytest.importorskip("tokenizers")
    docs, cfg, model = trained
    tok = tokenizers.Tokenizer(tokenizers.models.BPE(unk_token="<unk>"))
    tok.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel()
    trainer = tokenizers.trainers.BpeTrainer(vocab_size=cfg.vocab_size, special_tokens=list(cfg.special_tokens),
                                             min_frequency=cfg.min_frequency, show_progress=False)
    tok.train_from_iterator(TEXTS, trainer=trainer)
    hf = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in json.loads(tok.to_str())["model"]["merges"]]
    ours = [(r.left, r.right) for r in model.merges.orderBy("rank").collect()]
    assert ours == hf
    hf_vocab = tok.get_vocab()
    assert {r.token: r.id for r in model.vocab.collect()} == hf_vocab
    enc = {r.doc_id: r.ids for r in bpe.encode(docs, model, cfg, append_eos=False).collect()}
    for i, t in enumerate(TEXTS[:5]):
        assert enc[i] == tok.encode(t).ids


def test_single_and_batched_rounds_agree(spark, trained):
    docs, cfg, model = trained
    one = bpe.train_bpe(bpe.pretoken_counts(docs, "text", cfg), BPEConfig(vocab_size=180, merges_per_round=1))
    assert [tuple(r) for r in one.merges.orderBy("rank").collect()] == \
           [tuple(r) for r in model.merges.orderBy("rank").collect()]


def test_encode_decode_roundtrip_and_eos(spark, trained):
    docs, cfg, model = trained
    extra = spark.createDataFrame([(100, "ünseen ✓ bytes"), (101, ""), (102, "x" * 30)], "doc_id long, text string")
    allx = docs.unionByName(extra)
    enc = bpe.encode(allx, model, cfg, append_eos=True, max_len=5)
    lens = {r.doc_id: len(r.ids) for r in enc.collect()}
    assert all(n <= 5 for n in lens.values()) and lens[101] == 1
    full = bpe.encode(docs, model, cfg, append_eos=True)
    dec = {r.doc_id: r.text for r in bpe.decode(full, model).collect()}
    for i, t in enumerate(TEXTS):
        assert dec[i] == (t if t.startswith(" ") else " " + t)
    unk = [r.token for r in model.vocab.collect() if r.token == "<unk>"]
    assert unk and F is not None


def test_zero_texts_is_an_error(spark):
    empty = spark.createDataFrame([], "piece string, cnt long")
    with pytest.raises(ValueError):
        bpe.train_bpe(empty)


def test_load_or_train_reuses_saved_model(spark, trained, tmp_path):
    docs, cfg, model = trained
    path = str(tmp_path / "tok")
    counts = bpe.pretoken_counts(docs, "text", cfg)
    first = bpe.load_or_train(spark, path, counts, cfg)
    again = bpe.load_or_train(spark, path, None, cfg)          # nothing to train on: must load
    key = lambda m: [tuple(r) for r in m.merges.orderBy("rank").collect()]
    assert key(first) == key(again) == key(model)
    with pytest.raises(ValueError):
        bpe.load_or_train(spark, str(tmp_path / "missing"), None, cfg)


def test_decode_keeps_empty_rows_and_reports_faults(spark, trained):
    _, cfg, model = trained
    ids = {r.token: r.id for r in model.vocab.collect()}
    half = [ids[bpe.BYTE_CHARS[0xC3]]] if bpe.BYTE_CHARS[0xC3] in ids else [ids["a"]]
    df = spark.createDataFrame([(1, []), (2, half), (3, None), (4, [ids[cfg.eos_token], ids["a"]])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(df, model).collect()}
    assert got[1] == "" and got[3] is None and got[4] == "a" and set(got) == {1, 2, 3, 4}
    assert got[2] in ("\ufffd", "a")
    with pytest.raises(Exception, match="unknown token id"):
        bpe.decode(spark.createDataFrame([(1, [999_999])], "doc_id long, ids array<int>"), model).collect()


def test_encode_equals_the_public_library_on_documents(spark, tmp_path):
    """Every document of sf0.001, encoded with a tokenizer of the public library built from our model."""
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    cfg = BPEConfig(vocab_size=320)
    model = bpe.train_bpe(bpe.pretoken_counts(docs, "text", cfg), cfg)
    vocab = {r.token: r.id for r in model.vocab.collect()}
    merges = [(r.left, r.right) for r in model.merges.orderBy("rank").collect()]
    lib = Tokenizer(models.BPE(vocab, merges, unk_token="<unk>"))
    lib.pre_tokenizer, lib.decoder = pre_tokenizers.ByteLevel(add_prefix_space=True), decoders.ByteLevel()
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.ids for r in bpe.encode(docs, model, cfg, append_eos=False).collect()}
    assert all(got[d] == lib.encode(t).ids for d, t in texts.items())


def test_product_vocabulary_equals_the_public_trainer(spark, monkeypatch):
    """16,000 symbols (or as many as the texts give) on every document of sf0.001; few runs at a time."""
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    cfg = BPEConfig(vocab_size=16_000)
    tok = tokenizers.Tokenizer(tokenizers.models.BPE(unk_token="<unk>"))
    tok.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=True)
    trainer = tokenizers.trainers.BpeTrainer(vocab_size=cfg.vocab_size, special_tokens=list(cfg.special_tokens),
                                             min_frequency=cfg.min_frequency, show_progress=False)
    tok.train_from_iterator([r.text for r in docs.select("text").collect()], trainer=trainer)
    hf = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in json.loads(tok.to_str())["model"]["merges"]]
    monkeypatch.setattr(bpe, "CHAINS", 20_000)
    model = bpe.train_bpe(bpe.pretoken_counts(docs, "text", cfg), cfg)
    assert [(r.left, r.right) for r in model.merges.orderBy("rank").collect()] == hf
    assert {r.token: r.id for r in model.vocab.collect()} == tok.get_vocab()


def test_pair_table_by_differences_equals_a_recount(spark):
    import numpy as np
    rows = [([1, 2, 1, 2, 3], 5), ([2, 2, 2], 3), ([1], 7), ([], 2), ([3, 1, 2], 1)]
    words = spark.createDataFrame(rows, "s array<int>, cnt bigint").repartition(3)
    one = lambda df: {(r.p >> 32, r.p & 0xFFFFFFFF): r.c for r in df.collect()}
    assert one(bpe._pair_counts(words)) == {(1, 2): 11, (2, 1): 5, (2, 3): 5, (2, 2): 6, (3, 1): 1}
    held = spark.sparkContext.broadcast(np.array([1 << 32 | 2, 2 << 32 | 2]))
    runs = {tuple(np.frombuffer(r.run, "<i4").tolist()): r.cnt for r in bpe._runs(words, held).groupBy("run").agg(F.sum("cnt").alias("cnt")).collect()}
    assert runs == {(1, 2): 11, (2, 2, 2): 3}
    chains = [list(x) for x in runs]
    tokens, ids, merges = ["", "a", "b", "c"], {"a": 1, "b": 2, "c": 3}, []
    bpe._merge_in_order(chains, list(runs.values()), (-5, 2 << 32 | 1), BPEConfig(vocab_size=9), tokens, ids, merges)
    assert merges == [(0, "a", "b", "ab", 11), (1, "b", "b", "bb", 6)] and sorted(chains) == [[4], [5, 2]]
    new = spark.sparkContext.broadcast({np.array(k, "<i4").tobytes(): np.array(c, "<i4") for k, c in zip(runs, chains)})
    after = bpe._rewritten(words, held, new)
    assert sorted((r.s, r.cnt, r.was) for r in after.collect() if r.was) == [([3, 4], 1, [3, 1, 2]), ([4, 4, 3], 5, [1, 2, 1, 2, 3]), ([5, 2], 3, [2, 2, 2])]
    table = bpe._pair_counts(words).unionByName(bpe._differences(after)).groupBy("p").agg(F.sum("c").alias("c")).where("c != 0")
    assert one(table) == one(bpe._pair_counts(after.select("s", "cnt"))) == {(4, 4): 5, (4, 3): 5, (3, 4): 1, (5, 2): 3}


def test_training_reads_its_counts_once(spark):
    from millrace.config import BPEConfig
    from millrace.operators.bpe import train_bpe
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counts = spark.createDataFrame([("abab", 5), ("abc", 3), ("bc", 4)], "piece string, cnt bigint").mapInArrow(run, "piece string, cnt bigint")
    assert train_bpe(counts, BPEConfig(vocab_size=12)).merges.count() > 0
    assert seen.value == 3
