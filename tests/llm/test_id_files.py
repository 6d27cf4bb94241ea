import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest

PATH = P.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def library(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def blocks_of(seed):
    r = np.random.default_rng(seed)
    zipf = np.minimum(r.zipf(1.3, 3000) - 1, 50_256)
    phrase = r.integers(0, 50_257, 40)
    return [zipf[:2048], np.tile(phrase, 60)[:2048], r.integers(0, 50_257, 2048), np.zeros(1, np.int64), np.full(2048, 50_256), np.array([0, 50_256] * 500),
            zipf[:17], r.integers(0, 3, 2048), np.concatenate([phrase, r.integers(0, 600, 500), phrase]), np.arange(2048) * 24]


def test_blocks_round_trip():
    from millrace.llm.id_files import decode_blocks, encode_blocks
    for seed in range(4):
        blocks = blocks_of(seed)
        words = encode_blocks(blocks)
        for got, want in zip(decode_blocks(words, [len(b) for b in blocks]), blocks):
            assert np.array_equal(got, want)
        # A block's code does not depend on those beside it.
        assert [encode_blocks([b])[0] for b in blocks] == words
        assert len(words[1]) < 2048 and len(words[4]) < 300  # what repeats costs little


def test_encoder_equals_the_library():
    from millrace.llm.id_files import IdEncoder
    r = random.Random(1)
    texts = ["", " ", "a  b\n c", "<|endoftext|> in text <|endoftext|>", "é中\U0001F600", "it's  we'll", "  x  ", "a" * 400 + " " + "b" * 100]
    texts += ["".join(r.choice("ab eé \n'!1") for _ in range(r.randrange(200))) for _ in range(300)]
    e = IdEncoder(PATH)
    assert e.by_units
    for _ in range(2):
        assert [x.tolist() for x in e.encode(texts)] == library(texts)


def want(rows):
    order = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    out, start = [], 0
    for (d, _), ids in zip(order, library([t for _, t in order])):
        ids = ids + [0]
        out.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return sorted(out, key=repr)


def test_round_trip_of_odd_rows(spark):
    from millrace.llm.id_files import round_trip
    rows = [(i, "word " * (i % 50)) for i in range(300)] + [(5, "again"), (5, "again"), (7, None), (None, "no id"), (None, None), (-4, "first"), (1000, "x y " * 30_000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, before int").repartition(5)
    out = round_trip(df, PATH)
    assert sorted(map(tuple, out.collect()), key=repr) == want(rows)
    assert round_trip(df.limit(0), PATH).count() == 0


def test_query_on_the_given_documents(spark):
    from millrace.llm.queries import QUERIES
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op5_id_files"](spark, SF).collect()), key=repr) == want(rows)


def test_damage_is_found(spark, tmp_path):
    from millrace.llm.id_files import BLOCK, read_file, write_ids
    df = spark.createDataFrame([(i, f"some text number {i} " * 40) for i in range(60)], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    write_ids(df, f"file://{tmp_path}/ids", PATH)
    files = sorted((tmp_path / "ids").glob("part-*.ids"))
    data = files[0].read_bytes()
    docs = list(read_file(data))
    assert docs and sum(len(x) for _, x in docs) > BLOCK // 8
    for k in (3, 20, len(data) // 2, len(data) - 2):
        broken = data[:k] + bytes([data[k] ^ 64]) + data[k + 1:]
        with pytest.raises(ValueError):
            if list(read_file(broken)) == docs:
                pytest.skip("the byte is past what decoding reads")
    with pytest.raises(ValueError):
        list(read_file(data[:-9]))


def test_units_are_cut_at_single_spaces_only():
    from millrace.llm.id_files import units
    for text in ("", " ", "a b", " a  b ", "a\u00a0 b c", "it's 12 ok.\n x", "\u3000 a b\t c"):
        assert "".join(units(text)) == text
    assert units("ab cd  ef g") == ["ab", " cd  ef", " g"]


def test_blocks_of_ids_cost_one_step_an_id():
    from millrace.llm import id_files
    steps = []

    class Counted(id_files._Encoder):
        def _narrow(self, *a):
            steps.append(1)
            super()._narrow(*a)

    kept, id_files._Encoder = id_files._Encoder, Counted
    try:
        id_files.encode_blocks(blocks_of(9))
    finally:
        id_files._Encoder = kept
    assert len(steps) == 2048
    with pytest.raises(ValueError):
        id_files.encode_blocks([np.array([1, id_files.MOST + 1])])
