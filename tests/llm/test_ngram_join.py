import random
import re

import numpy as np
import pyarrow as pa
import pytest

SF = "/root/testdata/sf0.001"


def brute_sets(texts, width):
    out = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def brute(rows, width, num, den):
    sets = brute_sets([t for _, t in rows], width)
    label = list(range(len(rows)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def group(r, n, length, edits, tag):
    base = [f"{tag}{r.randrange(400)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w[r.randrange(3):]))
    return out


def rows_of(seed):
    r = random.Random(seed)
    texts = [None, "", " \t\n", "One", "one", "two words", "Two  Words", "a b c", "É é x", "é é x", "a\x0bb\x0cc d", "A B c D", "x\x1cy z w q"]
    for k in range(6):
        texts += group(r, 12, r.choice((20, 60, 150)), r.choice((2, 4, 8, 12)), f"g{k}x")
    texts += ["shared passage of quite a few words here " * 3 + " ".join(f"u{r.randrange(10**5)}" for _ in range(r.randrange(5, 40))) for _ in range(30)]
    texts += [texts[20]] * 5
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return [*rows, (3, "another text under the same id three"), (None, texts[20]), (None, "alone without an id")]


def test_shingle_sets_equal_brute_force():
    from millrace.llm.shingle_sets import shingle_sets
    texts = [t for _, t in rows_of(1)] + ["", "w " * 5000, "a" * 70_000 + " b c d e"]
    for width in (1, 4, 5):
        got, want = shingle_sets(pa.array(texts, pa.string()), width), brute_sets(texts, width)
        assert [len(x) for x in got] == [len(x) for x in want]
        ids = {}
        for g, w in zip(got, want):
            assert ids.setdefault(frozenset(w), g.tobytes()) == g.tobytes()
        for a in range(0, len(texts), 7):
            for b in range(0, len(texts), 5):
                assert len(np.intersect1d(got[a], got[b])) == len(want[a] & want[b])
    assert [len(x) for x in shingle_sets(pa.array(texts, pa.string())[3:9], 4)] == [len(x) for x in brute_sets(texts[3:9], 4)]


def test_spanning_links_equal_brute_force():
    from millrace.llm.ngram_join import spanning_links
    r = np.random.default_rng(4)
    for trial in range(30):
        base = np.sort(r.choice(500, 80, replace=False)).astype(np.uint64)
        sets = []
        for _ in range(40):
            s = set(base.tolist()) - set(r.choice(base, r.integers(0, 12)).tolist()) | set(r.integers(1000, 2000, r.integers(0, 10)).tolist())
            sets.append(np.array(sorted(s), np.uint64))
        label = list(range(40))
        for i in range(40):
            for j in range(i):
                o = len(np.intersect1d(sets[i], sets[j]))
                if 100 * o >= 85 * (len(sets[i]) + len(sets[j]) - o):
                    a, b = label[i], label[j]
                    label = [b if x == a else x for x in label]
        for known in (None, [k % 20 for k in range(40)]):
            want = list(label)
            if known:
                for k in range(20):
                    a, b = want[k], want[k + 20]
                    want = [b if x == a else x for x in want]
            got = list(range(40)) if not known else [k % 20 for k in range(40)]
            for a, b in spanning_links(sets, 85, 100, known):
                o = len(np.intersect1d(sets[a], sets[b]))
                assert 100 * o >= 85 * (len(sets[a]) + len(sets[b]) - o)
                x, y = got[a], got[b]
                assert x != y  # a forest
                got = [y if z == x else z for z in got]
            assert len(set(zip(got, want))) == len(set(want)) == len(set(got))


@pytest.mark.parametrize("width,num,den", [(4, 85, 100), (5, 80, 100)])
def test_near_duplicates_on_odd_rows(spark, width, num, den):
    from millrace.llm.ngram_join import near_duplicates, one_of_each
    rows = rows_of(width)
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n int").repartition(3)
    got = sorted(map(tuple, near_duplicates(df, width, num, den).collect()), key=repr)
    assert got == brute(rows, width, num, den)
    kept = one_of_each(df, width, num, den)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _, c in got if d == c or d is None} - {d for d, _, c in got if d != c and d is not None}
    assert near_duplicates(df.limit(0), width, num, den).count() == 0


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    from millrace.llm import ngram_join
    rows = rows_of(9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(ngram_join, "BROADCAST_SETS", 0)
    assert sorted(map(tuple, ngram_join.near_duplicates(df, 4, 85, 100).collect()), key=repr) == brute(rows, 4, 85, 100)


def test_query_on_the_given_documents(spark):
    from millrace.llm.queries import QUERIES
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op2_ngram_join"](spark, SF).collect()), key=repr) == brute(rows, 4, 85, 100)


def test_a_chain_of_sets_takes_linear_memory():
    """8,000 sets, each linked with its neighbours only: no array per set is kept."""
    import tracemalloc

    from millrace.llm.ngram_join import spanning_links
    sets = [np.arange(k, k + 30, dtype=np.uint64) for k in range(0, 24_000, 3)]
    tracemalloc.start()
    links = spanning_links(sets, 80, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(links) == len(sets) - 1 and peak < 100 << 20


@pytest.mark.parametrize("num,den", [(85, 100), (80, 100), (50, 100), (9, 10), (1, 1)])
def test_sets_that_link_share_a_key(num, den):
    """Whatever the sketch says: some pairs have few classes with shingles, some stand in different grades."""
    from millrace.llm.ngram_join import SKETCH, ListReader, index_keys
    r = np.random.default_rng(num)
    sets = []
    for n in [*range(1, 40), 63, 64, 65, 70, 255, 256, 257, 300, 1023, 1024, 1200]:
        base = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) | (r.integers(0, 2, n, dtype=np.uint64) << np.uint64(63)))
        if n % 5 == 0:
            base = base & np.uint64(0xFFFFFFFF)     # all in one class
        for _ in range(6):
            fewer = base[r.random(len(base)) > r.choice([0, .02, .08, .15])]
            more = r.integers(0, 1 << 32, int(len(base) * r.choice([0, .02, .1, .3])), dtype=np.uint64)
            sets.append(np.unique(np.r_[fewer if len(fewer) else base, more]))
    levels = r.integers(0, 9, SKETCH).astype(np.uint8)
    place, key, rank = index_keys(sets, levels, (9 - levels).astype(np.uint8), num, den)
    reader, lists = ListReader(num, den), {}
    for e in zip(place.tolist(), key.tolist(), rank.tolist()):
        lists.setdefault(e[1], []).append((len(sets[e[0]]), e[2], e[0]))
    for token, entries in lists.items():
        for n, i, x in sorted(entries):
            reader.entry(token, n, i, x)
    linked = 0
    for i in range(len(sets)):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * o >= num * (len(sets[i]) + len(sets[j]) - o) and not np.array_equal(sets[i], sets[j]):
                linked += 1
                assert reader.forest.root(i) == reader.forest.root(j), (len(sets[i]), len(sets[j]), o)
    assert linked > 50 or num == den


def test_chance_meetings_make_no_families(spark):
    """Texts over a small vocabulary share many single shingles; only copies are candidates, and only their sets are sent."""
    from millrace.llm import ngram_join
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(14)}" for _ in range(r.randrange(150, 250))) for _ in range(1500)]
    rows = [*enumerate(texts), *((5000 + k, texts[k] + " one more") for k in range(20))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    levels = ngram_join.sketch_levels(ngram_join.scan(df, 4))
    family = {x.id for x in ngram_join.families(ngram_join.postings(df, 4, levels, 85, 100), 85, 100).collect()}
    assert 40 <= len(family) < 60
    sids = {x.sid for x in ngram_join.scan(df, 4).where("n > 0").selectExpr("lower(hex(sid)) sid").collect()}
    members = spark.createDataFrame([(s,) for s in sids if s[:16] in family], "id string")
    sent = ngram_join.member_sets(df, members, 4).collect()
    assert {x.sid for x in sent} >= {x.id for x in members.collect()} and len(sent) < 80
    near = {x.doc_id: x.component_id for x in ngram_join.near_duplicates(df, 4, 85, 100).collect()}
    assert all(near[5000 + k] == near[k] == k for k in range(20))
