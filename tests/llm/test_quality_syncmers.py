import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
W = "[^\x20\x09-\x0d]+"


def brute_quality(text):
    w = re.findall(W, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(W, x)]
    wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    c = Counter(wins)
    hit = {j for i, x in enumerate(wins) if c[x] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed)


def odd_texts():
    r = random.Random(3)
    out = [None, "", " \n\t", "one", "a\n\na\n a\na", "x " * 50, "a b c d e f " * 3 + "g h", "é中\U0001F600 # *|<", "\x1c a b c", "a\r\nb\r\n" * 4]
    out += [" ".join(r.choice("abcd") for _ in range(r.randrange(1, 60))) for _ in range(150)]
    return out + [" ".join(str(i) for i in range(30_000)), "same words here again now " * 4000]


def test_features_equal_brute_force(spark):
    from millrace.llm.quality import quality_report
    texts = odd_texts()
    rows = [(i, t, None if i % 5 == 0 else "en", i) for i, t in enumerate(texts)] + [(None, "a b", "en", 0), (1, "a b", "en", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")
    out = quality_report(df, spark.createDataFrame([], "doc_id long, quality int"))
    got = sorted((tuple(r)[:7] for r in out.collect()), key=repr)
    assert got == sorted(((i, *brute_quality(t)) for i, t, _, _ in rows), key=repr)
    assert out.where(F.col("kept") != ~F.col("base_failed")).count() == 0  # no labels: no cutoffs
    assert quality_report(df.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def exact(r, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p)**(n - i) for i in range(r + 1))


def test_binomial_p_value(spark):
    from millrace.llm.quality import binomial_p_value
    cases = [(r, n) for n in (1, 2, 10, 50, 400, 1000) for r in (0, 1, 2, 5, 15, 30) if r <= n]
    df = spark.createDataFrame(cases, "r long, n long").select("r", "n", binomial_p_value(F.col("r"), F.col("n"), 0.04).alias("p"))
    for r, n, p in df.collect():
        if r < 0.04 * n:
            assert math.isclose(p, exact(r, n, 0.04), rel_tol=1e-9)
        else:
            assert p == 1.0
    big = spark.createDataFrame([(39_000, 1_000_000)], "r long, n long").select(binomial_p_value(F.col("r"), F.col("n"), 0.04)).first()[0]
    assert 1e-8 < big < 1e-6  # five standard deviations below the mean


def test_cutoffs_follow_the_labels(spark):
    from millrace.llm.quality import RULES, features, judge, keep_good, thresholds
    clean = " ".join(f"word{i}" for i in range(40))
    hashes = lambda n: "".join(f" #{k}" for k in range(n))  # noqa: E731  no repeated windows
    rows, labels = [], []
    for i in range(4000):
        lang = ("a", "b", None)[i % 3] if i < 3900 else "few"
        noisy = lang == "b" and i % 100 < 3
        rows.append((i, clean + (hashes(60) if noisy else f" x{i}"), lang))
        labels += [(i, 1), (i, 0)] if i % 7 == 0 else [(i, 1)]
    rows += [(10_000 + i, clean + hashes(200) + f" {i}", lang) for i, lang in enumerate(["a", "b", None, "few", "new"])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, quality int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    scored = features(df)
    cut = {r["__t_stratum"]: r["cutoffs"] for r in thresholds(scored, lab, alpha=0.1).collect()}
    assert set(cut) == {"a", "b", None}
    assert cut["a"]["symbols"] == min(RULES["symbols"][1]) and cut[None]["symbols"] == min(RULES["symbols"][1])
    # three in a hundred good documents of b hold 60 symbols to 100 words
    assert cut["b"]["symbols"] == 0.7
    got = {r.doc_id: r["__kept"] for r in judge(scored, thresholds(scored, lab, alpha=0.1)).collect() if r.doc_id >= 10_000}
    assert got == {10_000: False, 10_001: False, 10_002: False, 10_003: True, 10_004: True}
    kept = keep_good(df, lab, alpha=0.1)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3


def brute_edited(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for k, (i, t) in enumerate(order):
        nxt, n = order[(k + 1) % len(order)][1], len(t)
        e = t[:n - n // 4] + nxt[:n // 4]
        out.append((i, n, hashlib.sha256(e.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_fingerprints_on_odd_rows(spark):
    from millrace.llm.syncmers import edited_fingerprints
    rows = list(enumerate(odd_texts())) + [(5, "again " * 9), (5, "again " * 9), (5, None), (None, "null id é"), (-7, "first one here " * 8)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, sketch string").repartition(5)
    out = edited_fingerprints(df)
    got = out.collect()
    assert sorted((tuple(r)[:3] for r in got), key=repr) == brute_edited(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) <= 1024 for r in got)
    assert edited_fingerprints(df.limit(0)).count() == 0
    one = edited_fingerprints(df.where("doc_id = -7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprints_of_documents(spark):
    from millrace.llm.queries import QUERIES
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op3_syncmer_fingerprints"](spark, SF).collect()
    assert sorted((tuple(r)[:3] for r in got), key=repr) == brute_edited(list(rows.items()))
    by_text = {}
    for r in got:
        assert by_text.setdefault(rows[r.doc_id], r.fingerprint) == r.fingerprint
    # Against the exact likeness of all 5-word windows.
    order = sorted(rows)
    sh = lambda t: {tuple(u[i:i + 5]) for u in [re.findall("[^\x20\x09-\x0d]{1,16}", t)] for i in range(len(u) - 4)}
    off_edited, off_next = [], []
    for r in got:
        t, nxt = rows[r.doc_id], rows[order[(order.index(r.doc_id) + 1) % len(order)]]
        a, e, n = sh(t), sh(t[:len(t) - len(t) // 4] + nxt[:len(t) // 4]), sh(nxt)
        if len(a) >= 60:
            off_edited.append(abs(len(a & e) / len(a | e) - r.near_edited))
            off_next.append(abs(len(a & n) / len(a | n) - r.near_next))
    assert len(off_edited) > 50 and sum(off_edited) / len(off_edited) < 0.05 and sum(off_next) / len(off_next) < 0.02


def test_syncmers_are_context_free(spark):
    from millrace.llm.syncmers import anchors, matched_anchors
    r = random.Random(5)
    w = [f"w{r.randrange(500)}" for _ in range(300)]
    df = spark.createDataFrame([(" ".join(w), " ".join(["new", "start"] + w[:200]))], "a string, b string")
    a, b, m = df.select(anchors(F.col("a")), anchors(F.col("b")), matched_anchors(anchors(F.col("a")), anchors(F.col("b")))).first()
    inner = [x.hash for x in a if x.pos + 5 <= 200]
    assert [x.hash for x in b if x.pos >= 2] == inner  # the same windows are chosen at another place
    shift = Counter(x.right_pos - x.left_pos for x in m)
    assert shift[2] > 0.9 * len(m) and len(m) >= len(inner) * 0.95
    assert 0.3 < len(a) / 296 < 0.7


def test_short_texts_have_an_anchor(spark):
    from millrace.llm.syncmers import anchors, edited_fingerprints, likeness, sketch
    r = random.Random(6)
    texts = [" ".join(f"w{r.randrange(10_000)}" for _ in range(n)) for n in (1, 4, 5, 6, 7, 8) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = df.select("text", anchors(F.col("text")).alias("a"), sketch(F.col("text")).alias("s")).collect()
    assert all(x.a and x.s for x in rows)
    assert len({tuple(x.s) for x in rows if len(x.text.split()) in (5, 6)}) == 120  # unrelated texts differ
    got = edited_fingerprints(df.where("doc_id >= 120 and doc_id < 240")).collect()
    assert all(x.fingerprint and x.edited_fingerprint and x.near_next < 1 for x in got)
    empty = df.select(likeness(sketch(F.col("text")), sketch(F.lit(""))).alias("n")).agg(F.max("n")).first()[0]
    assert empty == 0.0
