"""Windows cut by a border-carry pass, padded batches on narrow keys, the epoch permutation."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.packing import (count_target_tokens, epoch_sampler, pack_blocks, pad_stream, permuted, stream_offsets,
                                        window_blocks, window_counts)


def _rows(seed, groups=("a", None, "c"), most=12):
    """Documents of several groups (null one among them), keys with a null, empty and null token lists."""
    r = random.Random(seed)
    rows, streams = [], {}
    for g in groups:
        at, stream = r.randrange(1000), []
        for i, k in enumerate([None, *range(r.randrange(20, 60))]):
            n = r.choice([0, 1, 2, r.randrange(most), r.randrange(most), 40 if i % 17 == 3 else 1])
            ids = list(range(at, at + n)) if i % 13 else None
            rows.append((g, k, ids))
            stream += ids or []
            at += n if ids is not None else 0
        streams[g] = stream
    r.shuffle(rows)
    return rows, streams


def _want(streams, span, stride):
    return sorted(((g, w, s[w * stride:w * stride + span]) for g, s in streams.items() for w in range(max(0, (len(s) - span) // stride + 1))), key=repr)


def _got(df, name):
    return sorted(((r.split, r[name], [*r.input_ids, r.labels[-1]]) for r in df.collect() if r.input_ids[1:] == r.labels[:-1]), key=repr)


@pytest.mark.parametrize("partitions", [2, 29])
@pytest.mark.parametrize("stride", [1, 3, 8, 20])
def test_windows_reach_over_partitions(spark, partitions, stride):
    rows, streams = _rows(stride)
    df = spark.createDataFrame(rows, "split string, k long, ids array<int>").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        assert _got(window_blocks(stream_offsets(df, ["k"]), 8, stride), "window_id") == _want(streams, 9, stride)
        assert _got(pack_blocks(stream_offsets(df, ["k"]), 8), "block") == _want(streams, 9, 9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_a_document_over_many_windows_and_text_keys(spark):
    rows = [("t", f"k{i:03}", list(range(s, s + n))) for i, (s, n) in enumerate([(0, 3), (3, 5000), (5003, 1), (5004, 2)])]
    df = spark.createDataFrame(rows, "split string, k string, ids array<bigint>")
    assert _got(pack_blocks(stream_offsets(df, ["k"]), 8), "block") == _want({"t": list(range(5006))}, 9, 9)


def test_tokens_move_once(spark):
    df = spark.createDataFrame([("t", i, [i]) for i in range(50)], "split string, k long, ids array<int>")
    plan = pack_blocks(stream_offsets(df, ["k"]), 8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") + plan.count("Repartition ") <= 1 and "Join" not in plan


def test_empty_table_gives_empty_blocks(spark):
    df = spark.createDataFrame([], "split string, k long, ids array<int>")
    assert pack_blocks(stream_offsets(df, ["k"]), 8).columns == ["split", "block", "input_ids", "labels"]
    assert pack_blocks(stream_offsets(df, ["k"]), 8).count() == 0


def test_pad_stream(spark, parts):
    rows = [("t", i, list(range(n + 1))) for i, n in enumerate([3, 1, 0, 5, 2])] + [("v", None, [7, 8])]
    df = spark.createDataFrame(rows, "split string, k long, ids array<int>").repartition(parts)
    out = {(r.split, r.k): r for r in count_target_tokens(pad_stream(stream_offsets(df, ["k"]), 2, 0)).collect()}
    assert {k: (r.batch, r.pos, len(r.input_ids), r.target_tokens) for k, r in out.items()} == {
        ("t", 0): (0, 0, 4, 3), ("t", 1): (0, 1, 4, 1), ("t", 2): (1, 2, 6, 0), ("t", 3): (1, 3, 6, 5), ("t", 4): (2, 4, 3, 2), ("v", None): (0, 0, 2, 1)}
    assert out["t", 3].input_ids == [0, 1, 2, 3, 4, 0] and out["t", 3].labels == [1, 2, 3, 4, 5, -100]


def test_the_permutation_is_a_bijection_for_every_size(spark):
    sizes = spark.range(1, 140).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("id") - 1)).alias("x"))
    out = sizes.withColumn("y", permuted(F.col("x"), F.col("n"), 5)).groupBy("n").agg(F.sort_array(F.collect_list("y")).alias("ys"), F.sum((F.col("x") == F.col("y")).cast("int")).alias("same"))
    rows = out.collect()
    assert all(r.ys == list(range(r.n)) for r in rows) and sum(r.same for r in rows) < 1_000
    big = spark.range(100_003).withColumn("n", F.lit(100_003)).withColumn("y", permuted(F.col("id"), F.col("n"), 9))
    assert big.select("y").distinct().where("y between 0 and 100002").count() == 100_003


def test_epochs_ranks_and_tails(spark, monkeypatch):
    from millrace.operators import packing
    monkeypatch.setattr(packing, "RUN", 7)
    counts = spark.createDataFrame([("a", 45), ("b", 3), ("c", 0)], "split string, n long")
    orders = []
    for epoch in (0, 1):
        rows = epoch_sampler(counts, 4, seed=1, epoch=epoch, drop_last=False).collect()
        assert sorted((r.split, r.window_id) for r in rows) == [("a", i) for i in range(45)] + [("b", i) for i in range(3)]
        assert sorted((r.split, r.sample_pos) for r in rows) == [("a", i) for i in range(45)] + [("b", i) for i in range(3)]
        assert all(r["rank"] == r.sample_pos % 4 for r in rows)
        orders.append(sorted((r.split, r.sample_pos, r.window_id) for r in rows))
    assert orders[0] != orders[1]
    kept = epoch_sampler(counts, 4, seed=1, epoch=0).collect()
    assert sorted((r.split, r.sample_pos) for r in kept) == [("a", i) for i in range(44)]
    lengths = spark.createDataFrame([("a", 10), ("a", 15), ("b", 9)], "split string, t long")
    assert {r.split: r.n for r in window_counts(lengths, "t", 8, 4).collect()} == {"a": 5, "b": 1}
    with pytest.raises(ValueError, match="too few tokens"):
        window_counts(lengths, "t", 9, 4)


def test_the_permutation_equals_its_definition_without_lambdas(spark):
    import hashlib
    import math

    from millrace.operators.packing import ROUNDS

    def place(x, n, seed):
        a = math.ceil(math.sqrt(n))
        b = (n + a - 1) // a
        while True:
            for j in range(ROUNDS):
                left, right = divmod(x, b)
                mixed = int(hashlib.md5(f"{seed}:{j}:{right if j % 2 == 0 else left}".encode()).hexdigest()[:12], 16)
                x = (left + mixed) % a * b + right if j % 2 == 0 else left * b + (right + mixed) % b
            if x < n:
                return x

    df = spark.range(57).withColumn("n", F.lit(57)).withColumn("y", permuted(F.col("id"), F.col("n"), 3))
    assert [r.y for r in df.orderBy("id").collect()] == [place(x, 57, 3) for x in range(57)]
    assert "lambdafunction" not in df._jdf.queryExecution().toString()


def test_word_ids_are_hashed_once_a_batch(spark):
    import hashlib

    from millrace.plans.tokens import word_ids
    df = spark.createDataFrame([("A b a",), (None,), (" ",), ("é b",)], "text_x string").coalesce(1)
    ids = df.select("text_x", word_ids().alias("ids"))
    want = {t: None if t is None else [int(hashlib.md5(w.encode()).hexdigest()[:3], 16) + 4 for w in t.lower().split()] for t, in df.collect()}
    assert {r.text_x: r.ids for r in ids.collect()} == want
    assert "lambdafunction" not in ids._jdf.queryExecution().toString()
