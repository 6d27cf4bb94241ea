import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.packing import count_target_tokens, pack_blocks, pad_batches, stream_offsets, window_blocks
from millrace.operators.position import global_positions
from millrace.operators.shards import assign_shards, token_budget


def _rows(n=300, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "b", "c"]), rng.randint(0, 50), float(rng.random())) for i in range(n)]


def test_global_positions_sum_and_min(spark, parts):
    rows = _rows()
    df = spark.createDataFrame(rows, "k long, g string, w long, v double").repartition(parts)
    got = {r.k: (r.pos, r.cum_before) for r in global_positions(df, ["k"], "w", ["g"]).collect()}
    mins = {r.k: r.cum_before for r in global_positions(df, ["k"], "v", ["g"], agg="min").collect()}
    for g in "abc":
        seq = sorted((r for r in rows if r[1] == g), key=lambda r: r[0])
        total, best = 0, None
        for i, r in enumerate(seq):
            assert got[r[0]] == (i, total)
            assert mins[r[0]] == best
            total += r[2]
            best = r[3] if best is None else min(best, r[3])


def _greedy(sizes, target):
    shard, fill, out = 0, 0, []
    for s in sizes:
        if fill > 0 and fill + s > target:
            shard, fill = shard + 1, 0
        out.append(shard)
        fill += s
    return out


@pytest.mark.parametrize("sizes,target", [
    ([3, 3, 4, 10, 1, 1, 25, 5, 5], 10),      # exact fill, oversize document alone
    ([10, 10, 10], 10),                       # each document fills a shard exactly
    ([1] * 40, 7),
    ([50], 10),
])
def test_assign_shards_matches_greedy(spark, sizes, target):
    df = spark.createDataFrame([("train", i, s) for i, s in enumerate(sizes)], "split string, k long, nb long")
    got = [r.shard for r in assign_shards(df, ["k"], "nb", target).orderBy("k").collect()]
    assert got == _greedy(sizes, target)


def test_assign_shards_random(spark, parts):
    rng = random.Random(3)
    sizes = {"train": [rng.randint(1, 30) for _ in range(400)], "val": [rng.randint(1, 90) for _ in range(50)]}
    rows = [(sp, i, s) for sp, ss in sizes.items() for i, s in enumerate(ss)]
    df = spark.createDataFrame(rows, "split string, k long, nb long").repartition(parts)
    out = assign_shards(df, ["k"], "nb", 64).collect()
    for sp, ss in sizes.items():
        got = [r.shard for r in sorted((r for r in out if r.split == sp), key=lambda r: r.k)]
        assert got == _greedy(ss, 64)


@pytest.mark.parametrize("fan", [2, 3, 64])
@pytest.mark.parametrize("target", [0, 1, 7, 64, 500, 100_000])
def test_assign_shards_levels_and_sizes(spark, fan, target):
    """Shards within a partition, over many partitions, and documents larger than a shard."""
    rng = random.Random(target)
    sizes = {"a": [rng.choice([0, 0, 1, 5, 30, 90, 700]) for _ in range(300)], "b": [rng.randint(0, 9) for _ in range(40)], None: [3], "c": [0, 0, 0]}
    rows = [(sp, i, s) for sp, ss in sizes.items() for i, s in enumerate(ss)]
    df = spark.createDataFrame(rows, "split string, k long, nb long").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        out = assign_shards(df, ["k"], "nb", target, fan=fan).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(out) == len(rows)
    for sp, ss in sizes.items():
        got = [r.shard for r in sorted((r for r in out if r.split == sp), key=lambda r: r.k)]
        assert got == _greedy_from(ss, target)


def _greedy_from(sizes, target):
    """The rule of the pointers: a shard goes on while its bytes stay within the target; a document at least."""
    out, shard, begin, before = [], -1, None, 0
    for s in sizes:
        if begin is None or before + s > begin + target:
            shard, begin = shard + 1, before
        out.append(shard)
        before += s
    return out


def test_null_and_repeated_keys(spark):
    schema = "split string, k long, ids array<int>, nb long"
    df = spark.createDataFrame([("t", None, [1], 4), ("t", 1, [1, 2], 4), (None, 2, [1], 4), ("t", 3, None, None)], schema)
    assert sorted(((r.split, r.k, r.shard) for r in assign_shards(df, ["k"], "nb", 4).collect()), key=str) == \
        sorted([("t", None, 0), ("t", 1, 1), (None, 2, 0), ("t", 3, 1)], key=str)
    assert sorted(((r.split, r.k) for r in token_budget(df, ["k"], "ids", 2).collect()), key=str) == sorted([("t", None), ("t", 1), (None, 2)], key=str)
    twice = df.unionByName(spark.createDataFrame([("t", 1, [9], 1)], schema))
    for run in (lambda: assign_shards(twice, ["k"], "nb", 4), lambda: token_budget(twice, ["k"], "ids", 2)):
        with pytest.raises(Exception, match="equal keys"):
            run().collect()


def test_token_budget(spark):
    df = spark.createDataFrame([("train", i, [1] * n) for i, n in enumerate([5, 5, 5, 5])],
                               "split string, k long, ids array<int>")
    assert token_budget(df, ["k"], "ids", 10).count() == 2
    assert token_budget(df, ["k"], "ids", 11).count() == 3        # crossing document kept whole
    assert token_budget(df, ["k"], "ids", 0).count() == 0
    assert token_budget(df, ["k"], "ids", {"val": 5}).count() == 0


def _docs(spark, parts, lens=(7, 1, 12, 3, 30, 2), split="train"):
    rows, t = [], 0
    for i, n in enumerate(lens):
        rows.append((split, i, list(range(t, t + n))))
        t += n
    return spark.createDataFrame(rows, "split string, k long, ids array<int>").repartition(parts), t


def test_pack_blocks(spark, parts):
    df, total = _docs(spark, parts)
    out = pack_blocks(stream_offsets(df, ["k"]), 8).orderBy("block").collect()
    assert len(out) == total // 9
    for r in out:
        chunk = list(range(r.block * 9, r.block * 9 + 9))
        assert r.input_ids == chunk[:-1] and r.labels == chunk[1:]


@pytest.mark.parametrize("stride", [1, 4, 8])
def test_window_blocks(spark, parts, stride):
    df, total = _docs(spark, parts)
    out = window_blocks(stream_offsets(df, ["k"]), 8, stride).orderBy("window_id").collect()
    assert len(out) == 1 + (total - 9) // stride
    for r in out:
        chunk = list(range(r.window_id * stride, r.window_id * stride + 9))
        assert r.input_ids == chunk[:-1] and r.labels == chunk[1:]


def test_window_blocks_too_short(spark):
    df, _ = _docs(spark, 1, lens=(3, 2))
    with pytest.raises(ValueError):
        window_blocks(stream_offsets(df, ["k"]), 8).collect()


def test_pad_batches(spark):
    df = spark.createDataFrame([("train", 0, 0, [5, 6, 7, 3]), ("train", 1, 1, [9, 3]), ("train", 2, 2, [3])],
                               "split string, k long, pos long, ids array<int>")
    out = {r.k: r for r in count_target_tokens(pad_batches(df, 3, 0)).collect()}
    assert out[0].input_ids == [5, 6, 7, 0] and out[0].labels == [6, 7, 3, -100]
    assert out[1].input_ids == [9, 0, 0, 0] and out[1].labels == [3, -100, -100, -100]
    assert out[2].input_ids == [0, 0, 0, 0] and out[2].labels == [-100] * 4
    assert [out[k].target_tokens for k in range(3)] == [3, 1, 0]
    assert F is not None


def test_positions_survive_coalesce_and_union(spark):
    """Position and running sum do not depend on how later plans group the partitions."""
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 13).alias("w")).repartition(6)
    want, total = {}, 0
    for r in sorted(df.collect()):
        want[r.k] = (len(want), total)
        total += r.w
    out = global_positions(df, ["k"], "w")
    for view in (out, out.coalesce(1), df.limit(0).selectExpr("k", "w", "0L pos", "0L cum_before").union(out), out.repartition(3)):
        assert {r.k: (r.pos, r.cum_before) for r in view.collect()} == want


def test_positions_of_many_groups(spark, parts):
    """100,000 groups, one of them a third of the rows: the driver gets a row per partition."""
    df = (spark.range(150_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("g"), "id", (F.col("id") % 5).alias("w"))
          .repartition(parts))
    out = global_positions(df, ["id"], "w", ["g"]).groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.max(F.col("cum_before") + F.col("w")).alias("end"), F.sum("w").alias("total"))
    assert out.count() == 100_001
    assert out.where((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("end") != F.col("total"))).count() == 0


def test_positions_evaluate_the_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    df = spark.range(1000).mapInArrow(count, "id long")
    assert global_positions(df, ["id"]).count() == 1000 and seen.value == 1000


def test_session_keeps_user_settings(spark):
    from millrace.session import build_session
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "777")
    try:
        assert build_session().conf.get("spark.sql.shuffle.partitions") == "777"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
