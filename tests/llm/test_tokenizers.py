import hashlib
import random
import struct

import public_tokenizers as P
import pytest

ODD = ["", " ", "  ", "\n", "a  b", " a", "a ", "a \n b", "x\u00a0 y", "it's we'll I'm", "\x1c \x1d", "\U0001F600 \U00010400x",
       "<|endoftext|> hi", "</s><s>", "a\u2581b", "\u6f22\u5b57\u304b\u306a", "e\u0301 \u00b2\u00bd", "\t\ttab", "a" * 3000, "ab" * 700,
       "\u00e9" * 500, " " * 300, "1234567890" * 30, "!?" * 200]


def random_texts(n, seed):
    r = random.Random(seed)
    alphabet = "abcdeit nsr  \n\t.,'!10\u00e9\u00df\u00a0\u4e2d\u0301\U0001F600"
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 400))) for _ in range(n)]


@pytest.fixture(scope="module")
def own():
    from millrace.llm.byte_bpe import RankBPE
    return RankBPE(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def test_rank_bpe_equals_the_public_library(own):
    import tiktoken
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for t in ODD + random_texts(400, 1):
        want = lib.encode_ordinary(t)
        got = own.encode(t)
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == want, t[:50]
        assert own.decode(got) == t.encode()


def test_columns_of_texts_equal_single_texts(own):
    """Units never span texts: texts that end or begin with spaces, letters and bytes of wide characters."""
    import pyarrow as pa
    import tiktoken
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    texts = ["a", " b", "", "c ", "d", None, "\u00e9", " \u00df x", "\u4e2d", " \u4e2d y", "\u00a0", " z", "x \u0085y", "\u3000 k", "k \u3000", "\u0414 \u0416", "a\u0301 b"] + random_texts(300, 9)
    for column in (pa.array(texts), pa.array(["cut", *texts, "cut"]).slice(1, len(texts)), pa.array([], pa.string())):
        got = own.encode_column(column)
        assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in got] == [lib.encode_ordinary(t or "") for t in column.to_pylist()]
    with pytest.raises(ValueError, match="not in the vocabulary"):
        own.decode(struct.pack("<I", 60_000))


def test_byte_bpe_query(spark):
    import tiktoken
    from millrace.llm.byte_bpe import RankBPE, decode, digests, encode, round_trip
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(99, None, None), (99, None, None), (None, "a b", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = digests(decode(encode(df, path, P.PATTERN), path)).collect()
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RankBPE(path, P.PATTERN).ranks, special_tokens={})
    want = []
    for i, t, _ in rows:
        ids = lib.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, round_trip(df, path, P.PATTERN).collect()), key=repr) == sorted(want, key=repr)
    with_ids = round_trip(df, path, P.PATTERN, with_ids=True)
    assert with_ids.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 and len(r.ids) == 4 * r.n_tokens for r in with_ids.collect())
    assert round_trip(df.limit(0), path, P.PATTERN).count() == 0
    assert digests(decode(encode(df.limit(0), path, P.PATTERN), path)).count() == 0


def test_chunked_counts_equal_whole_counts():
    from millrace.llm.token_counts import ChunkCounter
    whole = ChunkCounter(P.path("piece_bpe_32k.model"))
    texts = ODD + random_texts(200, 2) + ["word " * 2000, "nospace" * 900, "\u4e2d\u6587" * 800]
    for chunk, overlap in ((7, 2), (40, 8), (333, 30)):
        small = ChunkCounter(P.path("piece_bpe_32k.model"), chunk, overlap)
        assert small.counts(texts) == whole.whole(texts)


def test_token_counts_rows(spark):
    from millrace.llm.token_counts import token_counts
    import sentencepiece
    rows = [(i, t) for i, t in enumerate(ODD + ["long words " * 9000])] + [(7, None), (None, "x")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n_tokens int")
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = sorted(map(tuple, token_counts(df, P.path("piece_bpe_32k.model")).collect()), key=repr)
    want = [(a, len((b or "").encode()), n := len(lib.encode(b or "")), n > 4096) for a, b in rows]
    assert got == sorted(want, key=repr)
    assert token_counts(df.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_texts_go_to_python_in_batches_of_bounded_bytes(spark):
    import pyarrow as pa
    from millrace.llm.byte_bpe import encode
    from millrace.llm.common import BATCH_BYTES

    docs = spark.range(6000).repartition(1).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 400) as text")
    encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["rows", "bytes"])

    got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 6000 and max(r.bytes for r in got) < 4 * BATCH_BYTES
