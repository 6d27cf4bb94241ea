"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation is well formed when its role initials read ``(s?(ua)+)?``. Turns may be kept (0), given
the role user or assistant (3) or deleted (4, the only choice for blank and repeated turns), and empty
turns of user or assistant inserted anywhere (3); a truncated turn that stays adds 3. The cheapest edits
are a path through four states (nothing yet, after s, u, a).

1. Equal rows of a conversation are one row with a count. Rows are sorted by range, (conversation, turn,
   role, text), so a conversation of any length spans partitions; each partition cuts its runs into
   segments of at most ``SEGMENT`` rows.
2. A segment that may go on elsewhere is summed up in a 4 x 4 table: the least cost from state to state
   and the rank of the least audit at that cost. Tables compose, so a conversation's choice of a state
   at each border is one pass over narrow rows, one per segment.
3. Within a segment, forward and backward cost vectors meet in the middle; of the crossings that lie on
   a cheapest path, those of the least audit are taken, and both halves are solved anew. Space is
   linear: four numbers per level and the audit itself.

Every row's letter ends its part of the audit (insertions stand before it), so no audit of a part is a
beginning of another of the same rows, and the least whole audit has the least left part.

Ties and odd rows: null values read as one space; rows of one turn are ordered by role, then text; a
role whose first character is not s, u or a (or which is empty) is never kept; a null conv_id is one
conversation of its own; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise, n_buckets

#: Rows of a conversation in one segment, and characters of text.
SEGMENT, SEGMENT_CHARS = 2_048, 8 << 20
INF = 1 << 60
WHITE = " \t\n\x0b\x0c\r"
#: Fixed values of the contract.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FRESH, AFTER_S, AFTER_U, AFTER_A = range(4)
AFTER = {"s": {FRESH: AFTER_S}, "u": {FRESH: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
LEGAL = {"su", "ua", "au"}


def _insertions() -> list[list[int | None]]:
    """Insertions that lead from state to state."""
    n: list[list[int | None]] = [[None] * 4 for _ in range(4)]
    for p in range(4):
        n[p][p] = 0
        reached = [p]
        for q in reached:
            for r in (AFTER["u"].get(q), AFTER["a"].get(q)):
                if r is not None and n[p][r] is None:
                    n[p][r] = n[p][q] + 1
                    reached.append(r)
    return n


INSERTIONS = _insertions()
#: Insertions after the last row.
CLOSING = [min((n for q in (FRESH, AFTER_A) if (n := INSERTIONS[p][q]) is not None), default=None) for p in range(4)]
CLOSED = [INSERT * n for n in CLOSING]


def _step(role: str, truncated: bool) -> list[list[tuple[int, str]]]:
    """Least (cost, audit) from state to state over one row that may be kept."""
    best: list[list[tuple[int, str]]] = [[(INF, "")] * 4 for _ in range(4)]
    extra = TRUNCATED * truncated
    for p in range(4):
        for m in range(4):
            if (n := INSERTIONS[p][m]) is None:
                continue
            ways = [(m, DELETE, "D")]
            if role in AFTER and m in AFTER[role]:
                ways.append((AFTER[role][m], extra, "K"))
            ways += [(AFTER[x][m], REROLE + extra, "R") for x in "ua" if m in AFTER[x]]
            for q, cost, letter in ways:
                best[p][q] = min(best[p][q], (cost + INSERT * n, "I" * n + letter))
    return best


STEPS = {(role, t): _step(role, t) for role in ("s", "u", "a", "") for t in (False, True)}


def _unit(unit):
    """A unit is a number of rows to delete or the (initial, truncated) of a row to decide."""
    if isinstance(unit, int):
        return [[(DELETE * unit, "D" * unit) if p == q else (INF, "") for q in range(4)] for p in range(4)]
    return STEPS[unit]


def _forward(costs: list[int], units: list) -> list[int]:
    for unit in units:
        if isinstance(unit, int):
            costs = [c + DELETE * unit for c in costs]
        else:
            step = STEPS[unit]
            costs = [min(costs[p] + step[p][q][0] for p in range(4)) for q in range(4)]
    return costs


def _backward(costs: list[int], units: list) -> list[int]:
    for unit in reversed(units):
        if isinstance(unit, int):
            costs = [c + DELETE * unit for c in costs]
        else:
            costs = [min(step[q][0] + costs[q] for q in range(4)) for step in STEPS[unit]]
    return costs


def solve(entry: list[int], units: list, leave: list[int]) -> tuple[list[str], list[int]]:
    """The least audit, a string per unit, among the cheapest paths that pay ``entry`` for their first
    state and ``leave`` for their last; and the cost of each last state that this audit reaches."""
    if len(units) == 1:
        step = _unit(units[0])
        total, part = min((entry[p] + step[p][q][0] + leave[q], step[p][q][1]) for p in range(4) for q in range(4))
        out = [INF] * 4
        for p in range(4):
            for q in range(4):
                if step[p][q][1] == part and entry[p] + step[p][q][0] + leave[q] == total:
                    out[q] = total - leave[q]
        return [part], out
    half = len(units) // 2
    ahead, back = _forward(entry, units[:half]), _backward(leave, units[half:])
    total = min(f + b for f, b in zip(ahead, back))
    left, crossing = solve(entry, units[:half], [b if f + b == total else INF for f, b in zip(ahead, back)])
    right, out = solve(crossing, units[half:], leave)
    return left + right, out


def summary(units: list) -> tuple[list[int], list[int]]:
    """Cost and rank of the least audit from each state to each state, as two lists of 16."""
    costs = [0 if p == q else INF for p in range(4) for q in range(4)]
    ranks = [0] * 16
    for unit in units:
        step = _unit(unit)
        best = []
        for p in range(4):
            for q in range(4):
                best.append(min((costs[4 * p + m] + step[m][q][0], ranks[4 * p + m], step[m][q][1]) for m in range(4)))
        order = {k: i for i, k in enumerate(sorted({b[1:] for b in best}))}
        costs, ranks = [min(b[0], INF) for b in best], [order[b[1:]] for b in best]
    return costs, ranks


def borders(parts: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """The states before and after each segment of a conversation, from the segments' summaries."""
    back = [CLOSED]
    for costs, _ in reversed(parts):
        back.append([min(costs[4 * p + q] + back[-1][q] for q in range(4)) for p in range(4)])
    back.reverse()
    total = back[0][FRESH]
    at, rank, before = [0, INF, INF, INF], [0] * 4, []
    for k, (costs, ranks) in enumerate(parts):
        best, new = [], []
        for q in range(4):
            cost, r, own, p = min((at[p] + costs[4 * p + q], rank[p], ranks[4 * p + q], p) for p in range(4))
            good = cost + back[k + 1][q] == total
            best.append((cost if good else INF, p))
            new.append((r, own) if good else None)
        order = {x: i for i, x in enumerate(sorted(x for x in new if x is not None))}
        before.append([p for _, p in best])
        at, rank = [c for c, _ in best], [order.get(x, 0) for x in new]
    _, state = min((rank[q], q) for q in range(4) if at[q] < INF)
    out = []
    for ps in reversed(before):
        out.append((ps[state], state))
        state = ps[state]
    return out[::-1]


def damage(turns: DataFrame) -> DataFrame:
    """Rows damaged by a checksum of conversation and turn: dropped, emptied, cut, repeated or re-roled."""
    blank = F.lit(" ")
    k = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    role, text = F.coalesce(F.col("role").cast("string"), blank), F.coalesce(F.col("text").cast("string"), blank)
    return (turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), k.alias("k")).where("k != 0")
                 .select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
                         F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                         F.when(F.col("k") == 3, 2).otherwise(1).cast("bigint").alias("copies")))


def _in_order(turns: DataFrame) -> DataFrame:
    """Distinct rows with their count and whether role and text are there for the first time, sorted."""
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    rows = materialise(rows.withColumn("said", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))), "turns")
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(F.max(F.col("turn").isNull()).alias("untimed"), F.min("turn").alias("t"))
    both = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")))
    fresh = F.when(F.col("untimed"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("t"))
    both = both.select("conv_id", "turn", "role", "text", "n", fresh.alias("fresh"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return materialise(both, "turns-first").repartitionByRange(n_buckets(turns), *order).sortWithinPartitions(*order)


class Segment:
    """Rows of one conversation that follow one another, and what is counted of them."""

    def __init__(self, conv, whole: bool):
        self.conv, self.whole, self.roles, self.texts, self.units, self.of, self.chars = conv, whole, [], [], [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn, role: str, text: str, n: int, fresh: bool) -> None:
        initial = role[:1]
        self.illegal += (n - 1) + (self.last is not None and self.last + initial not in LEGAL)
        if self.first is None:
            self.first = initial
        self.last = initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        said = text.strip(WHITE)
        if not said:
            self.blank += n
        else:
            self.duplicate += n - fresh
        if said and fresh:
            cut = said[-1] not in ".!?"
            self.truncated += cut
            self.units.append((initial if initial in AFTER else "", cut))
            self.of.append(len(self.roles))
            self.roles.append(role)
            self.texts.append(text)
            self.chars += len(role) + len(text)
            n -= 1
        if n:
            if self.units and isinstance(self.units[-1], int):
                self.units[-1] += n
            else:
                self.units.append(n)
                self.of.append(-1)

    def row(self, number: int) -> dict:
        costs, ranks = (None, None) if self.whole else summary(self.units)
        kept = [(-u if isinstance(u, int) else "sua".find(u[0]) * 2 + u[1] if u[0] else 6 + u[1]) for u in self.units]
        return dict(conv_id=self.conv, seg=number, whole=self.whole, units=kept, roles=self.roles, texts=self.texts, blank=self.blank,
                    duplicate=self.duplicate, truncated=self.truncated, illegal=self.illegal, turns=self.distinct, low=self.low,
                    high=self.high, first=self.first, last=self.last, costs=costs, ranks=ranks)


def _units(codes: list[int]) -> list:
    return [-c if c < 0 else ("sua"[c // 2] if c < 6 else "", bool(c % 2)) for c in codes]


def _segments(ordered: DataFrame, size: int) -> DataFrame:
    conv, turn = ordered.schema["conv_id"].dataType.simpleString(), ordered.schema["turn"].dataType.simpleString()
    schema = (f"conv_id {conv}, seg bigint, whole boolean, units array<bigint>, roles array<string>, texts array<string>, blank bigint, duplicate bigint, "
              f"truncated bigint, illegal bigint, turns bigint, low {turn}, high {turn}, first string, last string, costs array<bigint>, ranks array<bigint>")

    def run(batches):
        number, now, ready = TaskContext.get().partitionId() << 32, None, []
        arrow = None

        def out():
            rows, ready[:] = list(ready), []
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        held = 0
        for batch in batches:
            if arrow is None:
                f = {x.name: x.type for x in batch.schema}
                longs, strings = pa.list_(pa.int64()), pa.list_(pa.string())
                arrow = pa.schema([("conv_id", f["conv_id"]), ("seg", pa.int64()), ("whole", pa.bool_()), ("units", longs), ("roles", strings), ("texts", strings),
                                   *((x, pa.int64()) for x in ("blank", "duplicate", "truncated", "illegal", "turns")), ("low", f["turn"]), ("high", f["turn"]),
                                   ("first", pa.string()), ("last", pa.string()), ("costs", longs), ("ranks", longs)])
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "fresh")]
            for conv, *row in zip(*columns):
                if now is None or now.conv != conv or len(now.roles) >= size or now.chars >= SEGMENT_CHARS:
                    ends = now is not None and now.conv != conv
                    if now is not None:
                        now.whole &= ends
                        ready.append(now.row(number))
                        held += now.chars
                        number += 1
                        if held > SEGMENT_CHARS // 4 or len(ready) >= 1_000:
                            held = 0
                            yield out()
                    # The partition's first conversation may have begun before it.
                    now = Segment(conv, ends)
                now.add(*row)
        if now is not None:
            now.whole = False
            ready.append(now.row(number))
            yield out()

    return materialise(ordered.mapInArrow(run, schema), "segments")


def _choices(segments: DataFrame) -> DataFrame:
    """``(of_seg, enter, leave, joins)`` of segments that may not be whole: their border states, and
    (turn repeated, illegal pair) with the segment before."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["seg"])
        states = borders([(r["costs"], r["ranks"]) for r in rows])
        same, illegal, high, last = [], [], None, None
        for r in rows:
            same.append(int(high is not None and r["low"] == high))
            illegal.append(int(last is not None and last + r["first"] not in LEGAL))
            high, last = r["high"] if r["high"] is not None else high, r["last"]
        return pa.table({"of_seg": [r["seg"] for r in rows], "enter": pa.array([p for p, _ in states], pa.int32()), "leave": pa.array([q for _, q in states], pa.int32()),
                         "final": pa.array([k == len(rows) - 1 for k in range(len(rows))]), "same": pa.array(same, pa.int64()), "pairs": pa.array(illegal, pa.int64())})

    narrow = segments.where(~F.col("whole")).select("conv_id", "seg", "costs", "ranks", "low", "high", "first", "last")
    return narrow.groupBy("conv_id").applyInArrow(run, "of_seg bigint, enter int, leave int, final boolean, same bigint, pairs bigint")


def repair(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Of ``(conv_id, turn, role, text, copies)`` rows: a row per segment of a conversation, ``seg`` in
    order, with its counts, ``audit``, ``cost`` and the repaired turns as ``new_roles``, ``new_texts``."""
    segments = _segments(_in_order(turns), segment)
    joined = segments.join(_choices(segments), F.col("seg") == F.col("of_seg"), "left").drop("of_seg", "costs", "ranks", "first", "last", "whole")
    kept = [c for c in joined.columns if c not in ("units", "roles", "texts", "enter", "leave", "final", "same", "pairs", "illegal", "turns")]
    schema = ", ".join([f"{c} {joined.schema[c].dataType.simpleString()}" for c in kept]
                       + ["illegal bigint", "turns bigint", "audit string", "cost bigint", "new_roles array<string>", "new_texts array<string>"])

    def run(batches):
        for batch in batches:
            audits, costs, new_roles, new_texts, illegals, distinct = [], [], [], [], [], []
            names = ("units", "roles", "texts", "enter", "leave", "final", "same", "pairs", "illegal", "turns")
            for codes, roles, texts, enter, leave, final, same, pairs, illegal, n in zip(*(batch.column(c).to_pylist() for c in names)):
                units, state = _units(codes), enter or FRESH
                final = final is None or final
                parts, reached = solve([0 if p == state else INF for p in range(4)], units,
                                       CLOSED if final else [0 if q == leave else INF for q in range(4)])
                cost, last = min((c + (CLOSED[q] if final else 0), q) for q, c in enumerate(reached))
                letters = "".join(parts) + "I" * (CLOSING[last] if final else 0)
                role_out, text_out, k, unit, left = [], [], 0, 0, 0
                for x in letters:
                    # Rows to delete have no role and text of their own here.
                    if x == "D":
                        if left == 0 and isinstance(units[unit], int):
                            left = units[unit]
                        if left:
                            left -= 1
                            unit += left == 0
                        else:
                            unit, k = unit + 1, k + 1
                        continue
                    role = "assistant" if state == AFTER_U else "user"
                    if x == "K":
                        role = roles[k]
                    text_out.append("" if x == "I" else texts[k])
                    role_out.append(role)
                    state = AFTER[role[0]][state]
                    if x != "I":
                        unit, k = unit + 1, k + 1
                audits.append(letters)
                costs.append(cost)
                new_roles.append(role_out)
                new_texts.append(text_out)
                illegals.append(illegal + (pairs or 0))
                distinct.append(n - (same or 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(illegals, pa.int64()), pa.array(distinct, pa.int64()), pa.array(audits, pa.string()), pa.array(costs, pa.int64()),
                 pa.array(new_roles, pa.list_(pa.string())), pa.array(new_texts, pa.list_(pa.string()))],
                names=kept + ["illegal", "turns", "audit", "cost", "new_roles", "new_texts"])

    return joined.mapInArrow(run, schema)


def report(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """A row per conversation of ``convs`` (conv_id): counts of faults, cost, audit and a digest of the
    repaired turns; zeros and empty values for a conversation without rows in ``turns``."""
    parts = repair(turns, segment)
    conv = parts.schema["conv_id"].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches):
        now, started = None, False
        done = []

        def close():
            at, low, high, n, sums, audit, digest, _ = now
            gaps = int(high - low) + 1 - n if low is not None else 0
            done.append((at, gaps, *sums, "".join(audit), digest.hexdigest()))

        def out():
            rows, done[:] = list(zip(*done)), []
            return pa.RecordBatch.from_arrays([pa.array(rows[0], arrow)] + [pa.array(x, pa.int64()) for x in rows[1:7]]
                                              + [pa.array(x, pa.string()) for x in rows[7:]], names=["conv_id", *counts, "audit", "repaired_sha256"])

        for batch in batches:
            arrow = batch.schema.field("conv_id").type
            names = ("conv_id", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "new_roles", "new_texts")
            for at, low, high, n, *rest in zip(*(batch.column(c).to_pylist() for c in names)):
                if not started or now[0] != at:
                    if started:
                        close()
                    started, now = True, [at, low, high, 0, [0] * 5, [], hashlib.sha256(), False]
                # Turns come in order, so the first that is not null is the least.
                now[1] = low if now[1] is None else now[1]
                now[2] = now[2] if high is None else high
                now[3] += n
                now[4] = [a + b for a, b in zip(now[4], rest[:5])]
                now[5].append(rest[5])
                for role, text in zip(rest[6], rest[7]):
                    now[6].update((("\n" if now[7] else "") + role + ":" + text).encode())
                    now[7] = True
            if len(done) >= 1_000:
                yield out()
        if started:
            close()
        if done:
            yield out()

    schema = f"conv_id {conv}, " + ", ".join(f"{c} bigint" for c in counts) + ", audit string, repaired_sha256 string"
    sorted_parts = parts.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "seg")
    found = sorted_parts.mapInArrow(run, schema)
    every = convs.select(F.col("conv_id").alias("c")).distinct()
    both = every.join(found, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    return both.select(F.col("c").alias("conv_id"), *(F.coalesce(x, F.lit(0)).alias(x) for x in counts), F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The conversations damaged, repaired and reported."""
    return report(damage(conversations), conversations)
