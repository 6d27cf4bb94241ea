import random
import re
from collections import Counter

import pytest

from millrace.llm import collocations as C

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
SCHEMA = "doc_id bigint, text string, lang string"


def brute(rows, least, top=2_000, longest=5):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i:i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    phrases = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    dropped = {(lang, v[i:j]) for (lang, v), b in phrases.items() for i in range(len(v)) for j in range(i + 2, len(v) + 1)
               if j - i < len(v) and b >= phrases[lang, v[i:j]]}
    out = {}
    for (lang, w), a in phrases.items():
        if (lang, w) not in dropped:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, xs in out.items() for i, (s, a, p, l, r) in enumerate(sorted(xs)[:top]))


def rows_of(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "new", "york", "NEW", "x\x1cy", "a-b", " ", "long" * 30]
    rows = []
    for _ in range(n):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "; ", " "]) for _ in range(r.randrange(0, 60)))
        rows.append((r.choice([text, text + " in the city of new york city!", text * 2]), r.choice(["en", "fr", None, "und", "", "en"])))
    return rows + [(None, "en"), ("", None), (" \t", "fr"), ("...", "zz"), ("a a a a a a " * 30, "en")] + rows[:5]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], SCHEMA).selectExpr("*", "1 AS n", "'x' AS id", "0 AS block").repartition(5)


def collected(df):
    assert df.columns == COLUMNS
    return sorted(tuple(x) for x in df.collect())


@pytest.mark.parametrize("broadcast", [C.BROADCAST_GROUPS, 0])
def test_equals_brute_force(spark, broadcast, monkeypatch):
    rows = rows_of(1, 500)
    expected = brute(rows, 8)
    assert len({len(x[2].split(" ")) for x in expected}) >= 4 and len(expected) > 200
    assert collected(C.collocations(frame(spark, rows), least=8, broadcast=broadcast)) == expected


def test_blocks_do_not_matter(spark, monkeypatch):
    rows = rows_of(2, 60)
    monkeypatch.setattr(C, "BLOCK_BYTES", 200)
    monkeypatch.setattr(C, "HELD_PAIRS", 30)
    monkeypatch.setattr(C, "BUCKET_PAIRS", 100)
    assert collected(C.collocations(frame(spark, rows), least=5, top=7)) == brute(rows, 5, top=7)


def test_packed_numbers_round_trip():
    for x in ([], [0], [5, -3, 1 << 62, 7], range(1000)):
        x = C.np.array(list(x), "<i8")
        assert C._unpacked(C._packed(x), len(x)).tolist() == x.tolist()


def test_no_phrase_and_empty_table(spark):
    rows = [("one two", "en"), (None, None)]
    assert collected(C.collocations(frame(spark, rows), least=2)) == []
    assert C.collocations(spark.createDataFrame([], SCHEMA), least=2).collect() == []


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 3_000_000_000_000
    phrases = spark.createDataFrame([("en", "a b c", big, [2 * big, big, big], [big + 1, big + 5, big], True)],
                                    "lang string, phrase string, a bigint, heads array<bigint>, tails array<bigint>, closed boolean")
    totals = spark.createDataFrame([("en", 10 ** 15)], "lang string, n bigint")
    monkeypatch.setattr(C, "frequent_phrases", lambda *a: (phrases, totals))
    got = C.collocations(phrases).first()
    score, k = min((1000 * big * 10 ** 15 // (h * t), k) for k, (h, t) in enumerate(((2 * big, big + 5), (big, big + 1))))
    assert (got["score"], got["l"], got["r"]) == (score, 2 * big if k == 0 else big, big + 5 if k == 0 else big + 1)


def test_registered_query(spark):
    import duckdb

    from millrace.llm.queries import QUERIES
    rows = duckdb.sql("select text, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    assert collected(QUERIES["op13_collocations"](spark, "/root/testdata/sf0.01")) == brute(rows, 100)
