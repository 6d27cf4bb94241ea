import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.config import LSHConfig, MinHashConfig
from millrace.functions.hashing import I64_MAX, MERSENNE31, universal_coefficients
from millrace.operators.components import cluster_map
from millrace.operators.lsh import band_keys, candidate_pairs
from millrace.operators.minhash import apply_minhash, batch_signatures, shingles
from millrace.operators.snapshot import attach_clusters, pick_representative


def _md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def test_shingles_edge_cases(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"],), (["a", "b", "c", "d", "e"],),
                                (["x"] * 7,), ([],), (["a|b", "c", "d", "e", "f"],),
                                (["a", "b c", "d", "e", "f"],), (["", "b", "c", "d", ""],)], "t array<string>")
    got = [r.s for r in df.select(shingles(F.col("t"), 5).alias("s")).collect()]
    assert got == [[], ["a|b|c|d|e"], ["x|x|x|x|x"], [], ["a|b|c|d|e|f"], ["a|b c|d|e|f"], ["|b|c|d|"]]


def _reference_sig(tokens, n=5, k=128, seed=1337):
    sh = {"|".join(tokens[i:i + n]) for i in range(len(tokens) - n + 1)} if len(tokens) >= n else set()
    a, b = universal_coefficients(k, seed)
    base = [int(_md5(s)[:7], 16) for s in sh]
    return [min(((ai * x + bi) % MERSENNE31 for x in base), default=I64_MAX) for ai, bi in zip(a, b)]


def test_minhash_arrow_native_and_python_agree(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    rows = [(str(i), [rng.choice(vocab) for _ in range(rng.randint(0, 40))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, tokens array<string>").repartition(4)
    arrow = {r.id: (r.sig_ok, r.sig) for r in apply_minhash(df, "tokens").collect()}
    native = {r.id: r.sig for r in apply_minhash(df, "tokens", impl="native").collect()}
    for i, toks in rows:
        ok, sig = arrow[i]
        assert ok == (len(toks) >= 5)
        if ok:
            assert sig == _reference_sig(toks) == native[i]
        else:
            assert sig == [I64_MAX] * 128


def test_batch_signatures_empty_and_chunking():
    a, b = np.array([[3], [5]], dtype=np.int64), np.array([[1], [2]], dtype=np.int64)
    vals = pa.array([[], [1, 2], list(range(40000)), [7]], pa.list_(pa.int64()))
    out = batch_signatures(vals, a, b).to_pylist()
    assert out[0] == [I64_MAX, I64_MAX]
    assert out[1] == [4, 7] and out[3] == [22, 37]
    assert out[2] == [1, 2]


def _components_bruteforce(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        if a and b:
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    return {x: _md5(min(g)) for g in groups.values() for x in g}


def test_components_chain_star_and_string_order(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(50)]
    star = [("s0", f"s{i}") for i in range(1, 30)]
    other = [("9", "10"), ("x", "y"), (None, "z"), ("", "q"), ("0", "00")]
    pairs = chain + star + other
    df = spark.createDataFrame(pairs, "id1 string, id2 string")
    got = {r.id: r.cluster_id for r in cluster_map(df).collect()}
    assert got == _components_bruteforce(pairs)
    assert got["9"] == _md5("10")            # ids compare as strings
    assert "z" not in got and "q" not in got  # null / empty ids are skipped


def test_star_edges_keep_components(spark, parts):
    # Buckets of 63, 64 and 5,000 ids: one pair per further member, and the
    # components that all pairs would give.
    sizes = {"a": 63, "b": 64, "c": 5000}
    rows = [(f"{g}{i:04d}", True, [k] * 8) for k, (g, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(f"s{i}", True, [i // 2 + 100] * 8) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, sig_ok boolean, sig array<bigint>").repartition(parts)
    pairs = candidate_pairs(band_keys(df, LSHConfig(k=8, b=2)))
    got = {tuple(r) for r in pairs.collect()}
    want = {(f"{g}0000", f"{g}{i:04d}") for g, n in sizes.items() for i in range(1, n)}
    assert got == want | {(f"s{i}", f"s{i + 1}") for i in range(0, 20, 2)}
    clusters = {r.id: r.cluster_id for r in cluster_map(pairs).collect()}
    assert len(clusters) == sum(sizes.values()) + 20 and len(set(clusters.values())) == 13


def test_attach_and_pick_representative(spark):
    rows = spark.createDataFrame([
        ("1", "abcd", "x"), ("2", "abcd", "xyz"), ("3", "ab", "zzzzz"), ("4", None, None), ("5", "q", "i")],
        "id string, code_ref string, instruction string")
    cmap = spark.createDataFrame([("1", "c"), ("2", "c"), ("3", "c")], "id string, cluster_id string")
    att = attach_clusters(rows, cmap)
    cl = {r.id: r.cluster_id for r in att.collect()}
    assert cl["4"] == _md5("4") and cl["1"] == "c"
    reps = {r.cluster_id: r.id for r in pick_representative(att, "cluster_id").collect()}
    assert reps["c"] == "2"      # longest code, then longest instruction
    tie = spark.createDataFrame([("a", "k", "x", "y"), ("b", "k", "x", "y")],
                                "id string, key string, code_ref string, instruction string")
    best = pick_representative(tie, "key").collect()[0].id
    assert best == min(["a", "b"], key=_md5)


def test_pairs_layout_independent(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(parts)
    from millrace.plans import dedup as dd
    got = sorted(tuple(r) for r in dd.pairs(docs).collect())
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got == sorted(tuple(r) for r in dd.pairs(base).collect())
    assert MinHashConfig().num_perm == 128


def test_cluster_snapshot_equals_the_two_steps(spark, parts):
    from millrace.operators.snapshot import cluster_snapshot, snapshot
    rng = random.Random(7)
    rows = [(str(i), "c" * rng.randrange(4), "i" * rng.randrange(3), f"d{i % 3}") for i in range(200)]
    rows += [("7", "cccccc", None, "x"), ("7", "c", "i", "y"), ("300", "q", "z", "w"), ("300", None, "z", "v"), (None, "n", "m", "u")]
    df = spark.createDataFrame(rows, "id string, code_ref string, instruction string, dataset string").repartition(parts)
    cmap = spark.createDataFrame([(str(i), f"k{i % 9}") for i in range(0, 120)], "id string, cluster_id string")
    want = sorted(map(tuple, snapshot(attach_clusters(df, cmap)).collect()), key=repr)
    cols = snapshot(attach_clusters(df, cmap)).columns
    assert sorted(map(tuple, cluster_snapshot(df, cmap).select(cols).collect()), key=repr) == want and len(want) == 9 + 80 + 2


def test_components_with_hot_centres(spark, monkeypatch):
    """Graphs in which every second node is above the limit, and a star whose edges stay spread."""
    import random

    from millrace.operators import components as cc
    monkeypatch.setattr(cc, "HOT", 2)
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100, k) for k in range(101, 160)] + [(k, 300) for k in range(200, 240)]
    root = {str(x): str(x) for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[str(a)] = root[str(b)] = min(root[str(a)], root[str(b)])
    alone = {str(x) for e in edges for x in e} - {str(x) for a, b in edges for x in (a, b) if a != b}
    df = spark.createDataFrame(edges, "id1 long, id2 long").repartition(5)
    assert {x.id: x.root for x in cc.component_roots(df).collect()} == {k: v for k, v in root.items() if k not in alone}
    monkeypatch.setattr(cc, "HOT", 10_000)
    star = spark.range(1, 200_001).selectExpr("'0' AS u", "cast(id AS string) AS v").repartition(8)
    sizes = [x["count"] for x in cc._with_least(star, star, 200_000).where("mv = '1'").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200_000 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def test_representative_of_repeated_rows(spark):
    """One row per key with ties in every length, repeated ids and repeated rows; no text in an aggregate."""
    from millrace.operators.snapshot import pick_representative
    rows = [("k1", 1, "abc", "x", 1), ("k1", 1, "abd", "y", 2), ("k1", 2, "ab", None, 3), ("k2", 5, "same", None, 4), ("k2", 5, "same", None, 4), ("k2", 5, "same", None, 4),
            ("k3", None, None, None, None), ("", 7, "zzz", "q", 5), (None, 8, "zzz", "q", 6)]
    df = spark.createDataFrame(rows, "k string, id long, code_ref string, instruction string, other long").withColumn("m", F.create_map(F.lit("a"), F.col("other")))
    for parts in (1, 4):
        out = pick_representative(df.repartition(parts), "k")
        assert out.columns == df.columns
        got = {r.k: (r.id, r.code_ref, r.other) for r in out.collect()}
        assert out.count() == 3 and got["k2"] == (5, "same", 4) and got["k3"] == (None, None, None) and got["k1"][0] == 1
    assert len({(pick_representative(df.repartition(p), "k").where("k = 'k1'").first().code_ref) for p in (1, 3, 5)}) == 1


def test_xxhash64_family_equals_the_public_library(spark):
    """The least 63-bit hash of (permutation, shingle): the permutation's four bytes seed the shingle's hash."""
    import struct

    import xxhash
    cfg = MinHashConfig(shingle_n=2, num_perm=5, seed0=7, hash_family="xxhash64")
    docs = [("a", "x é z w".split()), ("b", ["one"]), ("c", ["p", "p", "p"]), ("d", None)]
    out = {r.id: (r.sig_ok, r.sig) for r in apply_minhash(spark.createDataFrame(docs, "id string, tokens array<string>"), "tokens", cfg).collect()}
    shingle = {r.id: r.s for r in spark.createDataFrame(docs, "id string, tokens array<string>").where("size(tokens) > 1").select("id", shingles(F.col("tokens"), 2).alias("s")).collect()}
    for k, toks in docs:
        if toks and len(toks) > 1:
            want = [min(xxhash.xxh64_intdigest(s.encode(), seed=xxhash.xxh64_intdigest(struct.pack("<i", i + 7), seed=42)) & I64_MAX for s in shingle[k]) for i in range(5)]
            assert out[k] == (True, want)
        else:
            assert out[k] == (False, [I64_MAX] * 5)


def test_signatures_of_odd_tokens_and_small_blocks(spark, monkeypatch):
    from millrace.operators import minhash
    assert minhash._blocks(np.array([0, 3, 0, 5, 2])).__next__().tolist() == [1, 3, 4]
    monkeypatch.setattr(minhash, "_CHUNK", 4)
    assert [b.tolist() for b in minhash._blocks(np.array([0, 3, 0, 5, 2, 2]))] == [[1], [3], [4, 5]]
    docs = [("a", ["x", "y", "x", "y", "x", "y"]), ("b", None), ("c", []), ("d", ["", "é", "|", "z", "z"]), ("e", ["x", None, "z", "q", "r"])]
    df = spark.createDataFrame(docs, "id string, tokens array<string>")
    cfg = MinHashConfig(shingle_n=3, num_perm=8)
    native = {r.id: (r.sig_ok, r.sig) for r in apply_minhash(df, "tokens", cfg, impl="native").collect()}
    assert {r.id: (r.sig_ok, r.sig) for r in apply_minhash(df, "tokens", cfg).collect()} == native
    for family in ("universal31", "xxhash64"):      # no hash is taken in an interpreted lambda
        plan = apply_minhash(df, "tokens", MinHashConfig(hash_family=family))._jdf.queryExecution().toString()
        assert "lambdafunction" not in plan and "ArrowEvalPython" in plan


def test_summary_makes_the_pairs_once(spark, tmp_path, monkeypatch):
    from millrace.plans import dedup
    from millrace.plans.catalog import QUERIES
    text = " ".join(f"w{i}" for i in range(30))
    spark.createDataFrame([(1, text, "en", "s"), (2, text, "en", "s"), (3, "other words", "en", "s")],
                          "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    made, real = [], dedup.pairs
    monkeypatch.setattr(dedup, "pairs", lambda *a, **k: made.append(1) or real(*a, **k))
    got = {r.metric: r.value for r in QUERIES["d10_dedup_summary"](spark, str(tmp_path)).collect()}
    assert got == {"rows": 3, "kept_rows": 2, "pairs": 1, "clustered_ids": 2, "clusters": 1} and len(made) == 1
