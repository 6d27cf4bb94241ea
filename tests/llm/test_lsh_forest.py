import math
import random

import numpy as np
import pytest
from test_ngram_join import brute, group, rows_of

from millrace.llm import lsh_forest as L

SCHEMA = "doc_id bigint, text string"
COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]


def collected(df):
    assert df.columns == COLUMNS
    return sorted((tuple(x) for x in df.collect()), key=repr)


def expected(rows, width, num, den):
    return sorted(((d, n, c, d == c) for d, n, c in brute(rows, width, num, den)), key=repr)


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "'x' AS sid", "0 AS root").repartition(parts)


@pytest.mark.parametrize("seed,width,num", [(1, 4, 80), (2, 5, 80), (3, 3, 90)])
def test_equals_brute_force(spark, seed, width, num):
    rows = rows_of(seed)
    assert collected(L.near_duplicates(frame(spark, rows), width, num, 100)) == expected(rows, width, num, 100)


def test_small_blocks_and_deep_regions(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(L, "BROADCAST_SETS", 0)
    monkeypatch.setattr(L, "LEADERS", 2)
    rows = rows_of(4)
    assert collected(L.near_duplicates(frame(spark, rows), 4, 80, 100)) == expected(rows, 4, 80, 100)


def test_large_group_of_near_copies(spark):
    r = random.Random(9)
    rows = list(enumerate(group(r, 1_500, 120, 10, "g") + group(r, 40, 60, 2, "h") + ["one text"] * 300))
    assert collected(L.near_duplicates(frame(spark, rows, 13), 4, 80, 100)) == expected(rows, 4, 80, 100)


def test_regions_go_deeper_where_they_are_dense(monkeypatch):
    far = np.sort(np.r_[np.repeat(np.uint64(7 << 32 | 1), 5), np.repeat(np.uint64(7 << 32 | 2), 4), np.repeat(np.uint64(9 << 32), 6), np.uint64(10 << 32)])
    sketch = np.zeros((len(far), 2), np.uint64)
    whole = L.region_families(far, sketch, 100)
    assert [len(f) for f in whole] == [16]
    monkeypatch.setattr(L, "REGION", 7)
    assert sorted(len(f) for f in L.region_families(far, sketch, 100)) == [4, 5, 6]
    sketch[::2] = np.uint64(2 ** 64 - 1)
    monkeypatch.setattr(L, "REGION", 100)
    assert sorted(sorted(f.tolist()) for f in L.region_families(far, sketch, 100)) == [list(range(0, 16, 2)), list(range(1, 16, 2))]


def test_labels_agree_as_similarity_says():
    r = np.random.default_rng(4)
    n = L.trees(80, 100)
    assert (1 - .8 ** L.DEPTH) ** n < L.MISS
    agree, bits = [], []
    for _ in range(300):
        both, one, two = (np.unique(r.integers(0, 1 << 63, k, dtype=np.uint64)) for k in (80, 10, 10))
        near, _, sketch = L.signatures([np.sort(np.r_[both, one]), np.sort(np.r_[both, two])], n)
        agree.append((near[:, 0] == near[:, 1]).mean())
        bits.append(L.SKETCH_BITS - np.bitwise_count(sketch[:, 0] ^ sketch[:, 1]).sum())
    assert math.isclose(np.mean(agree), .8 ** L.DEPTH, abs_tol=.03)
    assert math.isclose(np.mean(bits), .9 * L.SKETCH_BITS, abs_tol=1) and min(bits) >= L.least_agreement(80, 100)


def test_search_finds_every_joining_link():
    r = random.Random(2)
    for _ in range(30):
        base = r.sample(range(1000), 40)
        sets = [np.sort(np.array(r.sample(base, r.randrange(30, 41)) + r.sample(range(2000, 2100), r.randrange(4)), np.uint64)) for _ in range(40)]
        index = L.Index(sets, list(range(40)), 80, 100)
        index.close()
        label = list(range(40))
        for i in range(40):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if 100 * len(a & b) >= 80 * len(a | b):
                    label = [label[i] if x == label[j] else x for x in label]
        assert len(set(zip(label, index.label.tolist()))) == len(set(label)) == len(set(index.label.tolist()))
        assert len(index.links) == 40 - len(set(label))


def test_empty_table(spark):
    assert L.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collected(L.near_duplicates(spark.createDataFrame([(1, None), (None, "")], SCHEMA))) == sorted([(1, 0, 1, True), (None, 0, None, True)], key=repr)


def test_registered_query(spark):
    import duckdb

    from millrace.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    assert collected(QUERIES["op11_lsh_forest"](spark, sf)) == expected(rows, 4, 80, 100)
