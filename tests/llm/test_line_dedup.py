import random
import re

import pytest
from pyspark.sql import functions as F


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def edit(r, s, n):
    s = list(s)
    for _ in range(n):
        k, at = r.randrange(3), r.randrange(len(s))
        if k == 0:
            s[at] = r.choice("xyzé\U0001F600")
        elif k == 1:
            s.insert(at, r.choice("xyz "))
        else:
            del s[at]
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3, 4])
def test_banded_distance(spark, edits):
    from millrace.llm.line_dedup import within
    r = random.Random(edits)
    pairs = [("", ""), ("a", ""), ("ab", "ba"), ("abc", "abc"), ("\U0001F600b", "\U0001F601b"), ("a" * 30, "a" * 33)]
    for _ in range(250):
        a = "".join(r.choice("ab é") for _ in range(r.randrange(1, 40)))
        pairs.append((a, edit(r, a, r.randrange(0, min(len(a), 7)))))
        pairs.append((a, "".join(r.choice("ab") for _ in range(r.randrange(1, 8)))))
    df = spark.createDataFrame(pairs, "a string, b string")
    for x in df.select("a", "b", within(F.col("a"), F.col("b"), edits).alias("near")).collect():
        assert x.near == (distance(x.a, x.b) <= edits), x


def brute(rows, edits, min_chars):
    docs = list(dict.fromkeys(rows))
    lines = sorted({x for _, t in rows for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)})
    up = {x: x for x in lines}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    long = [x for x in lines if len(x) >= min_chars]
    for i, a in enumerate(long):
        for b in long[:i]:
            if abs(len(a) - len(b)) <= edits and root(a) != root(b) and distance(a, b) <= edits:
                up[root(a)] = root(b)
    first = {}
    for d, t in docs:
        for no, x in enumerate((t or "").split("\n")):
            if x in up:
                first[root(x)] = min(first.get(root(x), (True, 1 << 70, 0)), (d is not None, d or 0, no))
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        x = t.split("\n")
        keep = [v for no, v in enumerate(x) if v not in up or first[root(v)] == (d is not None, d or 0, no)]
        out.append((d, "\n".join(keep), len(x), len(x) - len(keep)))
    return sorted(out, key=repr)


def rows_of(seed):
    r = random.Random(seed)
    line = lambda n: " ".join("".join(r.choice("abcdeéi") for _ in range(r.randrange(1, 8))) for _ in range(n))
    bases = [line(r.choice((6, 14, 16, 20, 40))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [line(r.randrange(1, 30)) for _ in range(r.randrange(0, 5))] + [edit(r, r.choice(bases), r.randrange(0, 4)) for _ in range(r.randrange(0, 5))]
        parts += ["", "  "] * r.randrange(2) + ["short one"] * r.randrange(3)
        r.shuffle(parts)
        rows.append((i, "\n".join(parts)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[4][1]), (104, rows[4][1]), (104, rows[4][1]), (None, "no id " + bases[0]), (-3, bases[1] + "\r\n" + bases[1])]
    rows += [(105, bases[2] + "\n" + bases[3]), (105, bases[4] + "\n" + bases[3])]
    r.shuffle(rows)
    return rows


def run(spark, rows, **k):
    from millrace.llm.line_dedup import dedup_lines
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, no int").repartition(3)
    out = dedup_lines(df, **k)
    assert out.columns == ["doc_id", "text", "no", "__n_lines", "__n_removed"]
    return sorted((tuple(x) for x in out.select("doc_id", "text", "__n_lines", "__n_removed").collect()), key=repr)


@pytest.mark.parametrize("edits,min_chars", [(2, 60), (3, 20)])
def test_dedup_equals_brute_force(spark, edits, min_chars):
    rows = rows_of(edits)
    assert run(spark, rows, edits=edits, min_chars=min_chars) == brute(rows, edits, min_chars)


def test_joins_by_shuffle_and_empty(spark, monkeypatch):
    from millrace.llm import line_dedup
    rows = rows_of(11)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert run(spark, rows, edits=1, min_chars=30) == brute(rows, 1, 30)
    assert run(spark, rows[:1], edits=2, min_chars=30) == brute(rows[:1], 2, 30)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(empty).count() == 0


def test_one_segment_held_by_lines_far_apart(spark):
    """A hot segment whose lines link with each other, but not with its least line."""
    r = random.Random(1)
    head = "the very same beginning of all these lines, "
    tails = ["".join(r.choice("abcdefgh") for _ in range(60)) for _ in range(25)]
    rows = [(i, head + t) for i, t in enumerate(tails)] + [(100 + i, head + edit(r, t, 1)) for i, t in enumerate(tails)]
    got = run(spark, rows, edits=2, min_chars=60)
    assert got == brute(rows, 2, 60) and sum(x[3] for x in got) == 25


def test_edits_follow_the_length(spark):
    from millrace.llm.line_dedup import TIERS
    r = random.Random(59)
    word = lambda n: "".join(r.choice("abcdefghij klmnop") for _ in range(n - 1)) + "."

    def changed(s, n):  # n characters, apart from each other
        s = list(s)
        for k in range(n):
            s[(2 * k + 1) * len(s) // (2 * n)] = "#"
        return "".join(s)
    cases = [(59, 1, 1), (59, 2, 0), (20, 1, 1), (19, 1, 0), (60, 2, 1), (60, 3, 0), (199, 2, 1), (199, 3, 0), (200, 3, 1), (1000, 3, 1), (1000, 4, 0)]
    rows, want = [], {}
    for i, (n, edits, gone) in enumerate(cases):
        line = word(n)
        rows += [(i, line), (1000 + i, changed(line, edits))]
        want[i], want[1000 + i] = 0, gone
    for i, n in enumerate((59, 60, 61, 199, 200)):  # across the bounds, the longer line one character longer
        line = word(n)
        rows += [(100 + i, line), (1100 + i, line[:n // 2] + "+" + line[n // 2:])]
        want[100 + i], want[1100 + i] = 0, 1
    got = {x[0]: x[3] for x in run(spark, rows, tiers=TIERS)}
    assert got == want


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines_within_the_edits_have_close_parities(spark, edits):
    from millrace.llm.line_dedup import _close, _pair_parity
    r = random.Random(edits)
    pairs = [("", ""), ("a", ""), ("ab", "a"), ("aa", "aaa"), ("\U0001F600b", "\U0001F601b")]
    for _ in range(200):
        a = "".join(r.choice("abcdefgh é\U0001F600") for _ in range(r.randrange(8, 120)))
        pairs.append((a, edit(r, a, edits)))
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where(~_close(_pair_parity(F.col("a")), _pair_parity(F.col("b")), edits)).collect() == []


def test_copies_far_apart_are_not_all_paired(spark, monkeypatch):
    """Copies of one line, each with another word in its middle: no two are near, and pairs of them
    that share all keys do not go on to the distance."""
    from millrace.llm import line_dedup
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(16)]
    rows = []
    for i in range(80):
        other = "".join(r.choice("abcdefghijklmnop") for _ in range(8))
        rows.append((i, " ".join(words[:7] + [other] + words[8:])))
    rows += [(100, rows[5][1][:-1] + "#"), (101, "zz" + rows[6][1])]
    counts, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *a: counts.append(pairs.count()) or verified(pairs, *a))
    assert run(spark, rows, edits=2, min_chars=60) == brute(rows, 2, 60)
    assert sum(counts) < 10 * len(rows), counts


def test_insertions_apart_are_not_all_paired(spark, monkeypatch):
    """Copies of one line, each with four characters of its own put in at a place of its own: no two are near, and
    most do not go on to the distance though few of their pairs of characters differ."""
    from millrace.llm import line_dedup
    r = random.Random(3)
    line = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(30))
    rows = []
    for i in range(60):
        at = r.randrange(140, len(line))
        rows.append((i, line[:at] + "".join(chr(0x4E00 + 4 * i + k) for k in range(4)) + line[at:]))
    rows += [(100, rows[5][1][:-1] + "#")]
    counts, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *a: counts.append(pairs.count()) or verified(pairs, *a))
    got = run(spark, rows, edits=3, min_chars=200)
    assert {x[0]: x[3] for x in got} == {i: int(i == 100) for i, _ in rows}
    assert sum(counts) < len(rows) * (len(rows) - 1) // 3, counts


def test_two_lines_meet_once(spark, monkeypatch):
    """Lines that share many finer keys come out of the join once or twice, not under each key."""
    from millrace.llm import line_dedup
    r = random.Random(4)
    line = "".join(r.choice("abcdefghijklmnop ") for _ in range(240))
    rows = []
    for i in range(40):
        at = r.randrange(150, 230)
        rows.append((i, line[:at] + "".join(r.choice("ab") for _ in range(5)) + line[at + 5:]))
    met, apart = [], line_dedup._apart

    def counted(finer, edits):
        out = apart(finer, edits)
        met.append((out.count(), out.distinct().count()))
        return out
    monkeypatch.setattr(line_dedup, "_apart", counted)
    assert run(spark, rows, edits=3, min_chars=200) == brute(rows, 3, 200)
    assert met and met[0][1] > 20 and met[0][0] <= 2 * met[0][1], met
