"""E6 token budget, E7 greedy byte-sized shards, E8 token width, E9 stats.

E7 reproduces the sequential writer exactly ("open a new shard when the
current one is non-empty and the next document would overflow it; a
document never spans shards") without a sequential pass:

* prefix sums give each document's byte range ``[cb, ca)`` in its split, in
  range partitions that each hold a slice of the order;
* a shard that starts at document ``i`` ends before the first later ``j`` with
  ``ca_j > v``, ``v = cb_i + target``. Inside a partition those pointers are
  followed in one task. What leaves it is the ``v`` of its last start, so a
  partition is a step function of the ``v`` that comes in, and only documents
  within ``target`` bytes of its beginning can be its first start. Starts that
  lead to the same ``v`` are one step;
* step functions compose: ``FAN`` neighbours become one, level by level, until
  a split has few enough for one task; then the ``v`` (and the number of
  shards before) of each is handed down again, one row per partition in the end;
* a last pass over each partition numbers its shards.

Documents are joined with the result once; equal keys in a split are an error,
null keys are keys.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.position import global_positions
from millrace.session import cut_lineage


def token_budget(df: DataFrame, order_cols: Sequence[str], tokens_col: str, target: int | dict,
                 group_cols: Sequence[str] = ("split",)) -> DataFrame:
    """Keep documents in order (``order_cols``; null is a key, a repeated key of a group an error)
    while the tokens before them are below the target; the crossing document is kept whole; a target
    ``<= 0`` skips the split. ``target`` is one number or ``{split: target}`` (missing = skip)."""
    keys = [*group_cols, *order_cols]
    narrow = df.select(*keys, F.size(tokens_col).alias("_nt"))       # only keys and lengths are ordered
    pos = global_positions(narrow, order_cols, weight="_nt", group_cols=group_cols, unique=True).drop("_nt")
    if isinstance(target, dict):
        t = F.lit(0).cast("bigint")
        for name, value in target.items():
            t = F.when(F.col("split") == name, F.lit(int(value))).otherwise(t)
    else:
        t = F.lit(int(target))
    return _join_on(df, pos.where((t > 0) & (F.col("cum_before") < t)), keys)


def _join_on(df: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which null equals null; the columns of ``df``, then the others."""
    named = found.select(*[F.col(c).alias(f"__{c}") for c in keys], *[c for c in found.columns if c not in keys])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(named, same).drop(*[f"__{c}" for c in keys])


def token_width(vocab_size: int) -> tuple[str, int]:
    """Storage type and bytes per token for a vocabulary size."""
    if vocab_size <= 0xFFFF:
        return "uint16", 2
    if vocab_size <= 0xFFFFFFFF:
        return "uint32", 4
    raise ValueError("vocabulary too large for uint32 token storage")


# Partitions of a split whose step functions one task composes.
FAN = 64


class Steps:
    """What a run of documents makes of the ``v`` that comes in: from the first ``key`` above ``v``, the
    ``v`` that goes out and the shards opened; a ``v`` above all keys goes through unchanged."""

    def __init__(self, begin: int, end: int, keys, exits, counts):
        self.begin, self.end = begin, end
        self.keys, self.exits, self.counts = (np.asarray(x, np.int64) for x in (keys, exits, counts))

    @classmethod
    def of_documents(cls, ca: np.ndarray, cb: np.ndarray, target: int) -> Steps:
        entries = int(np.searchsorted(ca, cb[0] + target, "left")) + 1
        at = np.arange(min(entries, len(ca)))
        chain, exits, counts = np.arange(len(at)), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        while len(at):
            heads, number = np.unique(at, return_inverse=True)   # chains that have met are followed once
            out = cb[heads] + target
            ahead = np.maximum(heads + 1, np.searchsorted(ca, out, "right"))
            counts[chain] += 1
            exits[chain] = out[number]
            at, more = ahead[number], ahead[number] < len(ca)
            at, chain = at[more], chain[more]
        return cls(int(cb[0]), int(ca[-1]), ca[:len(exits)], exits, counts).merged()

    def merged(self) -> Steps:
        last = np.r_[(self.exits[1:] != self.exits[:-1]) | (self.counts[1:] != self.counts[:-1]), True][:len(self.keys)]
        return Steps(self.begin, self.end, self.keys[last], self.exits[last], self.counts[last])

    def __call__(self, v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.keys, v, "right")
        inside, i = i < len(self.keys), i.clip(max=max(0, len(self.keys) - 1))
        return np.where(inside, self.exits[i], v), np.where(inside, n + self.counts[i], n)

    @classmethod
    def composed(cls, steps: list[Steps], target: int) -> Steps:
        keys, exits, counts = [], [], []
        for k, s in enumerate(steps):
            if s.begin >= steps[0].begin + target and k:
                break
            v, n = s.exits, s.counts
            for later in steps[k + 1:]:
                v, n = later(v, n)
            keys.append(s.keys)
            exits.append(v)
            counts.append(n)
        return cls(steps[0].begin, steps[-1].end, np.concatenate(keys), np.concatenate(exits), np.concatenate(counts)).merged()

    def row(self, group: str, place: int) -> dict:
        return dict(_g=group, place=place, begin=self.begin, end=self.end, keys=self.keys.tolist(), exits=self.exits.tolist(), counts=self.counts.tolist())


STEPS = "_g string, place bigint, begin bigint, end bigint, keys array<bigint>, exits array<bigint>, counts array<bigint>"
ARROW_STEPS = pa.schema([("_g", pa.string()), *((c, pa.int64()) for c in ("place", "begin", "end")), *((c, pa.list_(pa.int64())) for c in ("keys", "exits", "counts"))])


def _read(table: pa.Table) -> list[tuple[int, Steps]]:
    rows = table.select(ARROW_STEPS.names).to_pylist()
    return sorted(((r["place"], Steps(r["begin"], r["end"], r["keys"], r["exits"], r["counts"])) for r in rows), key=lambda x: x[0])


def _runs(batches):
    """(partition, group, batch slice) of each run of rows of one group in one partition."""
    for batch in batches:
        if batch.num_rows:
            g, p = batch.column("_g").to_numpy(zero_copy_only=False), batch.column("_part").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (p[1:] != p[:-1]), True]).tolist()
            for s, e in zip(cuts, cuts[1:]):
                yield int(p[s]), g[s], batch.slice(s, e - s)


def _bytes(run: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    cb = run.column("cum_before").to_numpy()
    return cb + run.column("nbytes").to_numpy(), cb


def _partition_steps(ordered: DataFrame, target: int) -> DataFrame:
    """Step functions of the first and the last group of each partition; others begin and end in it."""

    def run(batches):
        now, held, first = None, [], True

        def steps():
            ca, cb = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_pylist([Steps.of_documents(ca, cb, target).row(now[1], now[0])], schema=ARROW_STEPS)

        for part, group, rows in _runs(batches):
            if now != (part, group):
                if now is not None and (first or now[0] != part):
                    yield steps()
                first = now is None or now[0] != part
                now, held = (part, group), []
            held.append(_bytes(rows))
        if now is not None:
            yield steps()

    return ordered.select("_g", "_part", "nbytes", "cum_before").mapInArrow(run, STEPS)


def _entries(ordered: DataFrame, target: int, fan: int) -> dict[int, tuple[str, int, int]]:
    """By partition: the group that goes on in it, the ``v`` that comes in, the shards before. One row a partition."""
    levels = [cut_lineage(_partition_steps(ordered, target))]
    partitions = (levels[0].agg(F.max("place")).first()[0] or 0) + 1
    node = F.floor(F.col("place") / fan).cast("bigint")

    def compose(key, table):
        steps = [s for _, s in _read(table)]
        return pa.Table.from_pylist([Steps.composed(steps, target).row(key[0].as_py(), key[1].as_py())], schema=ARROW_STEPS)

    while partitions > fan:
        levels.append(cut_lineage(levels[-1].groupBy("_g", node.alias("node")).applyInArrow(compose, STEPS)))
        partitions = -(-partitions // fan)

    def down(table: pa.Table) -> pa.Table:
        v, n = np.array([table.column("v")[0].as_py()]), np.array([table.column("n")[0].as_py()])
        out = []
        for place, steps in _read(table):
            out.append((int(v[0]), int(n[0]), place))
            v, n = steps(v, n)
        v, n, place = zip(*out)
        return pa.table({"_g": pa.array([table.column("_g")[0].as_py()] * len(out), pa.string()), "place": pa.array(place, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n, pa.int64())})

    schema = "_g string, place bigint, v bigint, n bigint"
    given = levels[-1].withColumn("v", F.lit(-1).cast("bigint")).withColumn("n", F.lit(0).cast("bigint")).groupBy("_g").applyInArrow(down, schema)
    for level in levels[-2::-1]:
        above = given.select(F.col("_g").alias("a_g"), F.col("place").alias("a_place"), "v", "n")
        children = level.withColumn("node", node).join(above, (F.col("_g") == F.col("a_g")) & (F.col("node") == F.col("a_place")))
        given = children.drop("a_g", "a_place").groupBy("_g", "node").applyInArrow(down, schema)
    return {r["place"]: (r["_g"], r["v"], r["n"]) for r in given.where("v >= 0").collect()}   # the first run of a group has v = -1


def assign_shards(df: DataFrame, order_cols: Sequence[str], bytes_col: str, target_bytes: int,
                  group_cols: Sequence[str] = ("split",), fan: int = FAN) -> DataFrame:
    """Adds ``shard`` (0-based per group), ``pos`` and ``cum_before``.

    ``order_cols`` are unique per group, null a key like another (a repeated key is an error); a null
    size counts 0. Everything up to the shard number works on keys and byte counts."""
    group_cols, order_cols = list(group_cols), list(order_cols)
    keys = [*group_cols, *order_cols]
    gkey = F.to_json(F.array(*[F.col(c).cast("string") for c in group_cols])) if group_cols else F.lit("[]")
    narrow = df.select(*keys, F.coalesce(F.col(bytes_col).cast("bigint"), F.lit(0)).alias("nbytes"))
    ordered = cut_lineage(global_positions(narrow, order_cols, weight="nbytes", group_cols=group_cols, unique=True, part_col="_part").withColumn("_g", gkey))
    entries = _entries(ordered, target_bytes, fan)
    out_schema = ordered.drop("_g", "_part").withColumn("shard", F.lit(0)).schema

    def number(batches):
        now, v, n = None, -1, 0
        for part, group, rows in _runs(batches):
            if now != (part, group):
                now = (part, group)
                _, v, n = entries[part] if part in entries and entries[part][0] == group else (group, -1, 0)
            ca, cb = _bytes(rows)
            shard, i = np.empty(len(ca), np.int32), 0
            while i < len(ca):
                j = max(i, int(np.searchsorted(ca, v, "right")))
                shard[i:j] = n - 1
                if j < len(ca):
                    v, n = int(cb[j]) + target_bytes, n + 1
                    shard[j] = n - 1
                    j += 1
                i = j
            yield pa.RecordBatch.from_arrays([c for c, f in zip(rows.columns, rows.schema.names) if f not in ("_g", "_part")] + [pa.array(shard)],
                                             names=[f for f in rows.schema.names if f not in ("_g", "_part")] + ["shard"])

    placed = ordered.mapInArrow(number, out_schema).select(*keys, "pos", "cum_before", "shard")
    return _join_on(df.withColumn("nbytes", F.col(bytes_col).cast("bigint")), placed, keys)


def split_stats(df: DataFrame, text_col: str, tokens_col: str, eos_token: str | None,
                append_eos: bool = True) -> DataFrame:
    """Samples, chars (``len(text)`` + ``len(eos)`` when appended) and
    tokens per split."""
    extra = len(eos_token) if (append_eos and eos_token) else 0
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum(F.length(text_col) + F.lit(extra)).cast("bigint").alias("chars"),
        F.sum(F.size(tokens_col)).cast("bigint").alias("tokens"))
