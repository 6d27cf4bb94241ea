"""Training samples from token arrays.

Positions and token offsets come from E0 over keys and lengths alone. Token
arrays move once: each document goes to the range partition that its key falls
in (a binary search of the partitions' first keys, which E0 has settled), and
the few that a window beginning in an earlier partition still reaches go there
too. So a partition owns the windows that begin in it, and cuts them while its
documents stream by, with one window's tokens carried from batch to batch.
Neither groups of slices nor fragments are exchanged, and no token array is
written before the result.

What the driver holds is one row per range partition, as in E0.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.operators.position import global_positions
from millrace.operators.shards import _join_on
from millrace.session import cut_lineage

IGNORE_INDEX = -100


def pad_batches(df_with_pos: DataFrame, batch_size: int, pad_id: int, ids_col: str = "ids",
                pos_col: str = "pos", group_cols: Sequence[str] = ("split",)) -> DataFrame:
    """``input = ids[:-1]``, ``labels = ids[1:]``, both filled to the
    batch's longest ``len(ids)`` with ``pad_id`` / -100. (The width is the
    longest ``ids``, one more than any row holds, so the last column is
    always filler, as in the reference.)"""
    b = df_with_pos.withColumn("batch", F.floor(F.col(pos_col) / batch_size).cast("bigint"))
    width = F.max(F.size(ids_col)).over(Window.partitionBy(*group_cols, "batch"))   # <= batch_size rows per group
    return _padded(b.withColumn("_width", width), pad_id, ids_col)


def _padded(b: DataFrame, pad_id: int, ids_col: str) -> DataFrame:
    keep = F.greatest(F.size(ids_col) - 1, F.lit(0))
    fill = (F.col("_width") - keep).cast("int")
    return (b.withColumn("input_ids", F.concat(F.slice(ids_col, 1, keep), F.array_repeat(F.lit(pad_id), fill)))
             .withColumn("labels", F.concat(F.slice(ids_col, 2, keep), F.array_repeat(F.lit(IGNORE_INDEX), fill)))
             .drop("_width"))


def pad_stream(stream: Stream, batch_size: int, pad_id: int) -> DataFrame:
    """E10 over a stream: ``batch``, ``pos`` and the widths come from keys and lengths, so token arrays
    move once, to be joined with them."""
    g, keys = list(stream.group_cols), stream.keys
    placed = global_positions(stream.lengths(), stream.order_cols, group_cols=g, unique=True).drop("cum_before")
    placed = placed.withColumn("batch", F.floor(F.col("pos") / batch_size).cast("bigint"))
    width = F.max("_n").over(Window.partitionBy(*g, "batch"))            # <= batch_size rows per group
    return _padded(_join_on(stream.df, placed.withColumn("_width", width).drop("_n"), keys), pad_id, stream.ids_col)


@dataclass(frozen=True)
class Stream:
    """Documents whose tokens, in the order of ``order_cols`` (unique per group; null is a key), are the
    token stream of their group."""
    df: DataFrame
    order_cols: tuple[str, ...]
    ids_col: str
    group_cols: tuple[str, ...]

    @property
    def keys(self) -> list[str]:
        return [*self.group_cols, *self.order_cols]

    def lengths(self) -> DataFrame:
        """Keys and token counts (``_n``; null ids count 0)."""
        return self.df.select(*self.keys, F.greatest(F.coalesce(F.size(self.ids_col), F.lit(0)), F.lit(0)).cast("bigint").alias("_n"))


def stream_offsets(df: DataFrame, order_cols: Sequence[str], ids_col: str = "ids", group_cols: Sequence[str] = ("split",)) -> Stream:
    """The token streams of ``df``, a stream per group."""
    return Stream(df, tuple(order_cols), ids_col, tuple(group_cols))


@dataclass
class _Part:
    """A range partition: where its first group goes on, and where its last group's own documents end."""
    first_group: str
    start: int
    last_group: str
    end: int
    key: str        # of its first document, as JSON


def _parts(ordered: DataFrame, keys: list[str]) -> dict[int, _Part]:
    at = F.struct(F.col("_g"), F.col("cum_before"), F.to_json(F.struct(*keys)).alias("key"))
    rows = (ordered.withColumn("_i", F.monotonically_increasing_id()).groupBy("_part")
                   .agg(F.min_by(at, "_i").alias("a"), F.max_by(F.struct(F.col("_g"), (F.col("cum_before") + F.col("_n")).alias("end")), F.col("_i")).alias("z")).collect())
    return {r["_part"]: _Part(r["a"]["_g"], r["a"]["cum_before"], r["z"]["_g"], r["z"]["end"], r["a"]["key"]) for r in rows}


def _reaching(parts: dict[int, _Part], span: int, stride: int) -> list[tuple[int, int, int]]:
    """(partition, earlier partition, limit): documents of the first group that begin before ``limit``
    hold tokens of windows that begin in the earlier partition."""
    out, order = [], sorted(parts)
    for k, p in enumerate(order):
        for q in reversed(order[:k]):
            before = parts[q]
            if before.last_group != parts[p].first_group or before.end + span <= parts[p].start:
                break
            begun = before.start if before.first_group == before.last_group else 0
            last = (before.end - 1) // stride * stride
            if before.end > begun and last >= begun and last + span > parts[p].start:
                out.append((p, q, last + span))
            if before.first_group != before.last_group:
                break
    return out


def _literal(rows: list, kind: T.DataType) -> Column:
    """A constant table inside an expression."""
    return F.from_json(F.lit(json.dumps(rows)), kind, {"mode": "FAILFAST"})


def _found(key: Column, bounds: Column, n: int) -> Column:
    """The number of the last bound that is not above ``key``, by halving."""
    def halve(state: Column, _: Column) -> Column:
        mid = F.floor((state["lo"] + state["hi"] + 1) / 2).cast("int")
        below = F.element_at(bounds, mid + 1) <= key
        return F.struct(F.when(below, mid).otherwise(state["lo"]).alias("lo"), F.when(below, state["hi"]).otherwise(F.greatest(mid - 1, state["lo"])).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(n - 1).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, n.bit_length() + 1))), start, halve, lambda s: s["lo"])


def _windows(stream: Stream, seq_len: int, stride: int, id_col: str, whole_groups: bool) -> DataFrame:
    """Windows ``[i * stride, i * stride + seq_len + 1)`` of each group's tokens."""
    span, keys, groups = seq_len + 1, stream.keys, list(stream.group_cols)
    gkey = F.to_json(F.array(*[F.col(c).cast("string") for c in groups])) if groups else F.lit("[]")
    ordered = global_positions(stream.lengths(), stream.order_cols, weight="_n", group_cols=groups, unique=True, part_col="_part").withColumn("_g", gkey)
    ordered = cut_lineage(ordered)
    if whole_groups:
        totals = ordered.groupBy(*groups).agg(F.sum("_n").alias("_total"))
        short = totals.where(F.col("_total") < span).limit(1).collect()
        if short:
            raise ValueError(f"too few tokens for seq_len={seq_len}: {short[0].asDict()}")
    parts = _parts(ordered, keys)
    order = sorted(parts)
    number = {p: k for k, p in enumerate(order)}
    # The last document of a partition that a window of an earlier one still reaches, by (partition, earlier).
    reaching = _reaching(parts, span, stride)
    ends: dict[int, list] = {p: [] for p in order}
    if reaching:
        limits = ordered.sparkSession.createDataFrame(reaching, "p bigint, q bigint, top bigint")   # some rows per partition
        hit = ordered.join(F.broadcast(limits), F.col("_part") == F.col("p")).where(F.col("cum_before") < F.col("top"))
        first = {p: parts[p].first_group for p in order}
        tops = hit.groupBy("p", "q", "_g").agg(F.max_by(F.to_json(F.struct(*keys)), "pos").alias("k"))
        for r in tops.collect():
            if first[r["p"]] == r["_g"]:
                ends[r["p"]].append({"q": number[r["q"]], "k": json.loads(r["k"])})
    key_type = T.StructType([T.StructField(c, stream.df.schema[c].dataType) for c in keys])
    out_schema = T.StructType([stream.df.schema[c] for c in groups] + [T.StructField(id_col, T.LongType())]
                              + [T.StructField(c, stream.df.schema[stream.ids_col].dataType) for c in ("input_ids", "labels")])
    if not order:
        return stream.df.sparkSession.createDataFrame([], out_schema)
    bounds = _literal([json.loads(parts[p].key) for p in order], T.ArrayType(key_type))
    also = _literal([ends[p] for p in order], T.ArrayType(T.ArrayType(T.StructType([T.StructField("q", T.IntegerType()), T.StructField("k", key_type)]))))
    rows = stream.df.where(F.size(stream.ids_col) > 0).select(*keys, F.col(stream.ids_col).alias("_ids"), F.struct(*keys).alias("_key"))
    rows = rows.withColumn("_p", _found(F.col("_key"), bounds, len(order)))
    earlier = F.transform(F.filter(F.element_at(also, F.col("_p") + 1), lambda e: F.col("_key") <= e["k"]), lambda e: e["q"])
    rows = rows.withColumn("_to", F.explode(F.concat(F.array("_p"), earlier)))
    sort = [F.col(c).asc_nulls_first() for c in ["_to", *keys]]
    dealt = rows.select("_to", gkey.alias("_g"), *keys, "_ids").repartitionById(len(order), F.col("_to")).sortWithinPartitions(*sort)
    owned = {number[p]: parts[p] for p in order}

    def run(batches):
        now, held, at, end, first = None, [], 0, None, 0

        def cut(table_groups):
            """The windows that the tokens held complete; keeps the tokens of those that are not."""
            nonlocal held, at, first
            tokens = np.concatenate(held) if len(held) > 1 else held[0]
            n = (at + len(tokens) - first - span) // stride + 1      # windows from ``first`` on that are complete
            if end is not None:
                n = min(n, -(-(end - first) // stride))              # those that begin before ``end`` are ours
            out = None
            if n > 0:
                where = first - at + np.arange(n)[:, None] * stride + np.arange(span)
                chunk = tokens[where]
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * seq_len)
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x).ravel())) for x in (chunk[:, :-1], chunk[:, 1:])]
                out = pa.RecordBatch.from_arrays([*(g.take(pa.array(np.zeros(n, np.int64))) for g in table_groups), pa.array(first // stride + np.arange(n)), *lists],
                                                 names=[*groups, id_col, "input_ids", "labels"])
                first += n * stride
            drop = min(max(0, first - at), len(tokens))
            held, at = [tokens[drop:]], at + drop
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            to, g = batch.column("_to").to_numpy(), batch.column("_g").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (to[1:] != to[:-1]), True]).tolist()
            for a, b in zip(cuts, cuts[1:]):
                if now != (to[a], g[a]):
                    now, part = (to[a], g[a]), owned[int(to[a])]
                    at = part.start if part.first_group == g[a] else 0
                    end = part.end if part.last_group == g[a] else None
                    held, first = [], -(-at // stride) * stride
                held.append(batch.column("_ids").slice(a, b - a).flatten().to_numpy(zero_copy_only=False))
                out = cut([batch.column(c).slice(a, 1) for c in groups])
                if out is not None:
                    yield out

    return dealt.mapInArrow(run, out_schema)


def pack_blocks(stream: Stream, seq_len: int) -> DataFrame:
    """The split's stream cut into non-overlapping ``seq_len + 1`` chunks;
    ``input = chunk[:-1]``, ``labels = chunk[1:]``; the tail is dropped."""
    return _windows(stream, seq_len, seq_len + 1, "block", False)


def window_blocks(stream: Stream, seq_len: int, stride: int | None = None) -> DataFrame:
    """Windows ``[i*stride, i*stride + seq_len + 1)`` over each split's
    stream; ``1 + (n - (seq_len+1)) // stride`` windows; a split with fewer
    than ``seq_len + 1`` tokens is an error."""
    return _windows(stream, seq_len, stride or seq_len, "window_id", True)


def window_counts(lengths: DataFrame, n_col: str, seq_len: int, stride: int | None = None, group_cols: Sequence[str] = ("split",)) -> DataFrame:
    """``(group.., n)``: how many windows E12 cuts, from documents' token counts alone. Too few tokens in a
    group is the same error."""
    totals = cut_lineage(lengths.groupBy(*group_cols).agg(F.sum(n_col).cast("bigint").alias("_total")))
    short = totals.where(F.col("_total") < seq_len + 1).limit(1).collect()
    if short:
        raise ValueError(f"too few tokens for seq_len={seq_len}: {short[0].asDict()}")
    return totals.select(*group_cols, (F.floor((F.col("_total") - seq_len - 1) / (stride or seq_len)) + 1).cast("bigint").alias("n"))


def count_target_tokens(df: DataFrame, labels_col: str = "labels") -> DataFrame:
    """``target_tokens`` = labels that are not -100."""
    return df.withColumn("target_tokens", F.size(F.filter(labels_col, lambda x: x != IGNORE_INDEX)))


# Rounds of the permutation, steps of a walk back into range, and ids made in one task row.
ROUNDS, WALK, RUN = 6, 24, 65_536


def permuted(x: Column, n: Column, seed: int) -> Column:
    """A keyed bijection of 0..n-1: a Feistel network over (left, right) with ``left < a``, ``right < b``,
    ``a = ceil(sqrt(n))``, ``b = ceil(n / a)``, each round adding a hash of one half to the other. Values of
    the fewer than ``a`` places beyond ``n`` go through it again until they are below.

    There are about ``sqrt(n)`` halves, so a worker hashes each once a round and looks it up after that."""
    tables: dict[int, np.ndarray] = {}

    def mixed(j: int, half: np.ndarray) -> np.ndarray:
        known = tables.get(j, np.zeros(0, np.int64))
        if len(known) <= half.max():
            known = np.r_[known, np.full(int(half.max()) + 1 - len(known), -1, np.int64)]
        new = np.unique(half[known[half] < 0])
        known[new] = [int(hashlib.md5(f"{seed}:{j}:{h}".encode()).hexdigest()[:12], 16) for h in new.tolist()]
        tables[j] = known
        return known[half]

    def network(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        for j in range(ROUNDS):
            left, right = v // b, v % b
            v = (left + mixed(j, right)) % a * b + right if j % 2 == 0 else left * b + (right + mixed(j, left)) % b
        return v

    @F.arrow_udf("bigint")
    def place(xs: pa.Array, ns: pa.Array) -> pa.Array:
        if not len(xs):
            return pa.array([], pa.int64())
        if xs.null_count or ns.null_count:
            raise ValueError("a permutation needs a place and a size")
        v, size = xs.to_numpy(), ns.to_numpy()
        a = np.ceil(np.sqrt(size.astype(np.float64))).astype(np.int64)
        b = (size + a - 1) // a
        v = network(v, a, b)
        for _ in range(WALK):
            far = np.flatnonzero(v >= size)
            if not len(far):
                break
            v[far] = network(v[far], a[far], b[far])
        if (v >= size).any():
            raise ValueError("the walk did not come back into range")
        return pa.array(v, pa.int64())

    # Not copied into filters; a pure function of its input all the same.
    return place.asNondeterministic()(x.cast("bigint"), n.cast("bigint"))


def epoch_sampler(counts: DataFrame, world_size: int, seed: int, epoch: int, drop_last: bool = True,
                  group_cols: Sequence[str] = ("split",), key_col: str = "window_id") -> DataFrame:
    """A fresh permutation per epoch (keyed by ``seed + epoch``) of the windows 0..n-1 of each row of
    ``counts`` (``group.., n``), dealt round-robin to ranks; ``drop_last`` drops the tail that would leave
    ranks unequal. Ids are made from the counts and placed one by one: nothing is sorted or read."""
    n = F.col("n")
    runs = counts.where(n > 0).select(*group_cols, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / RUN).cast("bigint"))).alias("_run"))
    runs = runs.repartition(*group_cols, "_run")
    last = F.least((F.col("_run") + 1) * RUN, n) - 1
    ids = runs.select(*group_cols, "n", F.explode(F.sequence(F.col("_run") * RUN, last)).alias(key_col))
    out = ids.withColumn("sample_pos", permuted(F.col(key_col), n, seed + epoch))
    out = out.withColumn("rank", F.pmod("sample_pos", F.lit(world_size)).cast("int"))
    if drop_last:
        out = out.where(F.col("sample_pos") < F.floor(n / world_size) * world_size)
    return out.drop("n")
