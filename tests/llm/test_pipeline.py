import hashlib
import struct
from collections import Counter

import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
import test_line_dedup
import test_ngram_join
from test_mixing_warc import check
from test_quality_syncmers import brute_quality

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, monkeypatch):
    """Each stage on what the one before kept; sf0.001 has too few labels for a cutoff."""
    whole = test_line_dedup.distance
    far = lambda a, b: sum(((Counter(a) - Counter(b)) + (Counter(b) - Counter(a))).values()) > 4  # noqa: E731  a lower bound, times two
    monkeypatch.setattr(test_line_dedup, "distance", lambda a, b: 99 if far(a, b) else whole(a, b))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = [x for x in rows if not brute_quality(x[1])[-1]]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        out = spark.createDataFrame(out.collect(), out.schema)
        got = [(r.doc_id, r.text) for r in out.collect()]
        if k == 1:
            want = [(d, t) for d, t, _, _ in test_line_dedup.brute(rows, 2, 60)]
            assert all(r.n_chars == len(r.text) for r in out.collect())
        if k == 2:
            alone = {d for d, _, c in test_ngram_join.brute(rows, 5, 80, 100) if c == d}
            want = [x for x in rows if x[0] in alone]
        if k == 3:
            from millrace.llm.mixing import mix, quality_weights
            mixed = mix(docs, quality_weights(spark.read.parquet(f"{SF}/labels.parquet"))).collect()
            check(mixed, [(r.doc_id, r.text, r.source) for r in docs.collect()])
            copies = {r.doc_id: r.copies for r in mixed}
            want = [x for x in rows for _ in range(copies[x[0]])]
        assert sorted(got) == sorted(want), name
        docs, rows = out, got
    import tiktoken
    from millrace.llm.byte_bpe import RankBPE
    path = P.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RankBPE(path, P.PATTERN).ranks, special_tokens={})
    want = []
    for d, t in rows:
        ids = lib.encode_ordinary(t)
        raw = struct.pack(f"<{len(ids)}I", *ids)
        want.append((d, len(ids), raw, hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    last = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert last.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert sorted((r[0], r[1], bytes(r[2]), *r[3:]) for r in last.collect()) == sorted(want)
    ran = corpus_pipeline.run(spark, SF)
    assert sorted((r[0], r[1], bytes(r[2]), *r[3:]) for r in ran.collect()) == sorted(want)


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty texts, repeated rows and ids, clashing column names, an empty table."""
    words = ["harbour", "lantern", "meadow", "copper", "window", "ladder", "saddle", "orchard", "kettle", "ribbon", "anchor", "basket", "candle", "dragon"]
    clean = lambda k: " ".join(words[(k * i + i // 3) % 14] + str(k * 31 + i) for i in range(40)) + "."
    rows = [(1, clean(1), "en", "a"), (2, clean(2), None, None), (2, clean(2), None, None), (3, None, "en", "a"), (4, "", "fr", "b"), (None, clean(5), "en", None),
            (None, clean(6), "en", "a"), (7, clean(7), "zz", "b"), (8, clean(1) + " End.", "en", "b"), (9, clean(9), "en", "a")]
    df = spark.createDataFrame([(*x, "n", 5, None) for x in rows], "doc_id long, text string, lang string, source string, n string, copies int, sid string").withColumn("n_chars", F.length("text").cast("bigint"))
    for docs in (df.repartition(3), df.limit(0)):
        now = docs
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, SF)
            got = out.collect()
            assert out.columns == docs.columns or k == 4
            if k < 4:
                now = spark.createDataFrame(got, docs.schema)
            ids = [r.doc_id for r in got]
            if not docs.limit(1).count():
                assert got == [], name
            elif k < 3:
                assert {3, 4}.isdisjoint(ids) and {1, 2, 7, 9} <= set(ids) and ids.count(None) == 2, name
                assert all((r.n, r.copies, r.sid) == ("n", 5, None) for r in got)
                assert (8 in ids) == (k < 2), name
            else:
                assert {3, 4, 8}.isdisjoint(ids)


def test_pipeline_is_registered():
    import __spark_entry__ as E
    assert E.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in E.oracle_sql()
    assert {k.split("_")[0] for k in E.queries() if k.startswith("op")} == {f"op{n}" for n in range(1, 14)}
