import hashlib
import itertools
import random
import re
import zlib

import pytest

from millrace.llm import conversation_repair as R

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute_edits(rows, forced, cut):
    """Least (cost, audit, repaired) by trying every string of edits, shortest path over (row, roles so far)."""
    best = {(0, ""): (0, "", ())}
    out = []
    for i in range(len(rows) + 1):
        level = {k: v for k, v in best.items() if k[0] == i}
        for _ in range(4):      # up to four insertions before a row
            for (_, seen), (c, a, done) in list(level.items()):
                for r in ("user", "assistant"):
                    s = seen + r[0]
                    key, new = (i, s[-4:]), (c + 3, a + "I", done + ((r, ""),))
                    if re.fullmatch("(s?(ua)*u?)", s) and (key not in level or new[:2] < level[key][:2]):
                        level[key] = new
        if i == len(rows):
            out = [v for (_, s), v in level.items() if re.fullmatch("(s?(ua)+)?", s)]
            break
        role, text = rows[i]
        for (_, seen), (c, a, done) in level.items():
            ways = [(seen, c + 4, a + "D", done)]
            if not forced[i]:
                extra = 3 * cut[i]
                if role[:1]:
                    ways.append((seen + role[0], c + extra, a + "K", done + ((role, text),)))
                ways += [(seen + r[0], c + 3 + extra, a + "R", done + ((r, text),)) for r in ("user", "assistant")]
            for s, c2, a2, d2 in ways:
                if re.fullmatch("s?(ua)*u?", s):
                    # (ua)* repeated is one state: keep the shortest word with the same continuations
                    key = (i + 1, _state(s))
                    if key not in best or (c2, a2) < best[key][:2]:
                        best[key] = (c2, a2, d2)
    return min(out)


def _state(s):
    return "" if not s else "s" if s == "s" else ("ua" if s[-1] == "a" else "u")


def brute(table, damaged=True):
    convs = {}
    for c, t, role, text in table:
        convs.setdefault(c, [])
        role, text, copies = " " if role is None else role, " " if text is None else text, 1
        if damaged:
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            if k == 0:
                continue
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            copies = 2 if k == 3 else 1
            role = "user" if k == 4 else role
        convs[c] += [(t, role, text)] * copies
    out = []
    for c, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, forced, cut, counts = set(), [], [], [0, 0, 0]
        for _, role, text in rows:
            said = re.findall("[^\x20\x09-\x0d]", text)
            fault = 0 if not said else 1 if (role, text) in seen else 2 if said[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            forced.append(fault in (0, 1))
            cut.append(fault == 2)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, done = brute_edits([r[1:] for r in rows], forced, cut)
        out.append((c, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()))
    return sorted(out, key=repr)


def table_of(seed, n):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), None]:
        for t in range(r.randrange(1, 12)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "ux"])
            text = r.choice(["Yes.", "no", " \t", None, "", "Done!  \n", "é?", "a b.", "\x1c", "u" * r.randrange(1, 4) + "."])
            rows.append((c, r.choice([t, t, t, t + 1, None, -t]), role, text))
    return rows + [rows[3]] * 3


def collected(df):
    assert df.columns == COLUMNS
    return sorted((tuple(x) for x in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = table_of(seed, 60)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS seg", "'x' AS audit", "2 AS n").repartition(5)
    assert collected(R.repair_damaged(df)) == brute(rows)


@pytest.mark.parametrize("segment", [1, 2, 3])
def test_segments_of_any_size_agree(spark, segment):
    rows = table_of(7, 25)
    df = spark.createDataFrame(rows, SCHEMA)
    assert collected(R.report(R.damage(df), df, segment=segment)) == brute(rows)


def test_long_conversation_spans_partitions(spark):
    r = random.Random(3)
    rows = [(5, t, r.choice(["user", "assistant", "system"]), r.choice([f"Line {t}.", f"cut {t}", "", "Again."])) for t in range(3_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert collected(R.report(R.damage(df), df, segment=100)) == brute(rows)


def test_divide_and_conquer_against_all_paths():
    r = random.Random(5)
    for _ in range(400):
        units = [r.choice([r.randrange(1, 3), *R.STEPS]) for _ in range(r.randrange(1, 7))]
        for p, q in itertools.product(range(4), range(4)):
            paths = [(0, "", p)]
            for u in units:
                step = R._unit(u)
                paths = [(c + step[m][k][0], a + step[m][k][1], k) for c, a, m in paths for k in range(4) if step[m][k][0] < R.INF]
            ends = [(c, a) for c, a, m in paths if m == q]
            costs, _ = R.summary(units)
            assert (min(ends)[0] if ends else R.INF) == costs[4 * p + q]
            if ends:
                parts, reached = R.solve([0 if x == p else R.INF for x in range(4)], units, [0 if x == q else R.INF for x in range(4)])
                assert ("".join(parts), reached[q]) == (min(ends)[1], min(ends)[0])


def test_empty_and_all_dropped(spark):
    assert R.repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []
    dropped = next(t for t in range(100) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    rows = [(1, dropped, "user", "x")]
    assert collected(R.repair_damaged(spark.createDataFrame(rows, SCHEMA))) == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_registered_query(spark):
    import duckdb

    from millrace.llm.queries import QUERIES
    rows = duckdb.sql("select conv_id, turn, role, text from '/root/testdata/sf0.01/conversations.parquet'").fetchall()
    assert collected(QUERIES["op12_conversation_repair"](spark, "/root/testdata/sf0.01")) == brute(rows)
