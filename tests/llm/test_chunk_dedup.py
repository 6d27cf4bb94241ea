import random
from collections import defaultdict

import numpy as np

from millrace.llm.chunk_dedup import GEAR, MAX_CHUNK, MIN_BYTES, MIN_CHUNK, cuts, gear_hash


def arr(b):
    return np.frombuffer(b, np.uint8)


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghiéo") for _ in range(r.randrange(2, 9))) for _ in range(n))


def test_gear_hash_rolls():
    data = bytes(random.Random(1).randrange(256) for _ in range(500))
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert gear_hash(arr(data)).tolist() == want
    assert gear_hash(arr(data[:1])).tolist() == want[:1] and cuts(arr(b"")) == []


def test_cuts_cover_and_resist_shifts():
    r = random.Random(2)
    for text in (prose(r, 3000), "a" * 5000, "é" * 2000, "x", "\U0001F600" * 700):
        raw = text.encode()
        c = cuts(arr(raw))
        assert c == sorted(set(c)) and c[-1] == len(raw)
        parts = [raw[a:b] for a, b in zip([0, *c], c)]
        assert b"".join(parts) == raw and all(p.decode() or True for p in parts)
        assert all(len(p) <= MAX_CHUNK for p in parts) and all(len(p) >= MIN_CHUNK - 3 for p in parts[:-1])
    a = prose(r, 3000).encode()
    b = a[:4000] + b"something inserted" + a[4000:]
    own = lambda x: {x[s:e] for s, e in zip([0, *cuts(arr(x))], cuts(arr(x)))}
    assert len(own(a) - own(b)) <= 4


def brute(rows, min_bytes):
    docs = list(dict.fromkeys((d, t) for d, t in rows if t))
    places = defaultdict(list)
    for d, t in rows:
        raw, at = (t or "").encode(), 0
        for e in cuts(arr(raw)):
            places[raw[at:e]].append(d)
            at = e
    key = lambda d: (d is not None, d or 0)
    out = []
    for d, t in docs:
        raw, at, span, seen = t.encode(), 0, None, set()
        for e in [*cuts(arr(raw)), None]:
            part = raw[at:e] if e else None
            first = min(places[part], key=key) if e else None
            repeat = bool(e) and len(places[part]) > 1 and (first != d or part in seen)
            if e and first == d:
                seen.add(part)
            if repeat:
                if span is None:
                    span = [at, 0, 0, None, 0]
                span[1], span[2] = e - span[0], span[2] + 1
                if e - at > span[4]:
                    span[3], span[4] = first, e - at
            elif span is not None:
                if span[1] >= min_bytes:
                    out.append((d, *span[:4]))
                span = None
            at = e
    return sorted(out, key=repr)


def rows_of(seed):
    r = random.Random(seed)
    shared = [prose(r, 60) for _ in range(4)]
    line = prose(r, 10)
    rows = [(i, "\n".join([prose(r, r.randrange(20, 200)), line] + [r.choice(shared)] * (i % 3 == 0) + [prose(r, 50)])) for i in range(60)]
    rows += [(100, rows[5][1]), (101, shared[0] + " " + shared[0]), (102, None), (103, ""), (104, "q" * 3000), (105, "q" * 2000), (None, shared[1] + prose(r, 30))]
    rows += [(106, rows[7][1]), (106, rows[7][1]), (107, prose(r, 90)), (107, prose(r, 90)), (-5, shared[2])]
    r.shuffle(rows)
    return rows


def test_spans_equal_brute_force(spark):
    from millrace.llm.chunk_dedup import repeated_passages
    rows = rows_of(3)
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, d1 int").repartition(4)
    out = repeated_passages(df)
    cols = ["doc_id", "start_byte", "n_bytes", "n_chunks", "first_doc_id"]
    got = sorted((tuple(r) for r in out.select(cols).collect()), key=repr)
    assert got == brute(rows, MIN_BYTES) and len(got) > 20
    assert repeated_passages(df.limit(0)).count() == 0


def test_planted_passages_are_found(spark):
    from millrace.llm.chunk_dedup import repeated_passages, without_passages
    r = random.Random(8)
    passage, line = [prose(r, 52) for _ in range(40)], prose(r, 9)
    rows, want = [], set()
    for i in range(400):
        text = prose(r, 120) + "\n" + line + "\n"
        if i % 4 == 0:
            text += passage[i // 4 % 40] + " " + prose(r, 80)
            if i >= 160:
                want.add((i, i - 160 if i < 320 else i - 320))
        rows.append((i, text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeated_passages(df)
    got = {(x.doc_id, x.first_doc_id) for x in found.collect()}
    assert not got - want and len(got) >= 0.97 * len(want)
    cut = without_passages(df, found)
    assert cut.columns == df.columns and cut.count() == 400
    texts = {x.doc_id: x.text for x in cut.collect()}
    assert all(texts[i] == t for i, t in rows if i not in {a for a, _ in got})
    assert all(len(texts[a].encode()) <= len(rows[a][1].encode()) - MIN_BYTES for a, _ in got)


def test_every_planted_passage_is_found_whole(spark):
    from millrace.llm.chunk_dedup import repeated_passages, whole_passages, without_passages
    r = random.Random(51)
    words = lambda n, a, b: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzéß中") for _ in range(r.randrange(a, b + 1))) for _ in range(n))
    passages = [words(51, a, b) for a, b in ((2, 7), (2, 5), (3, 8)) for _ in range(120)]
    rows, want = [], {}
    for i, p in enumerate(passages):
        for doc in (i, 1000 + i):
            before = words(r.randrange(0, 60), 2, 8) + " "
            rows.append((doc, before + p + " " + words(r.randrange(0, 60), 2, 8)))
            want[doc] = (len(before.encode()), len(p.encode()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = whole_passages(df)
    got = {x.doc_id: x for x in found.collect()}
    assert sorted(got) == [1000 + i for i in range(len(passages))] and found.count() == len(got)
    for doc, x in got.items():
        start, n = want[doc]
        assert x.first_doc_id == doc - 1000
        assert x.start_byte <= start and x.start_byte + x.n_bytes >= start + n and x.n_bytes <= n + 8  # a byte or two of the surroundings may agree
    assert repeated_passages(df).select("doc_id").distinct().count() < len(passages)  # what whole chunks alone find
    texts = dict(rows)
    for doc, text in without_passages(df, found).collect():
        x = got.get(doc)
        raw = texts[doc].encode()
        assert text.encode() == (raw[:x.start_byte] + raw[x.start_byte + x.n_bytes:] if x else raw)


def test_whole_passages_on_odd_rows(spark):
    from millrace.llm.chunk_dedup import whole_passages
    rows = [(d, t) for d, t in rows_of(3)] + [(200, "z" * 127), (201, "z" * 127), (202, "y" * 128 + "1"), (203, "y" * 128 + "2")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, d1 int").repartition(4)
    got = whole_passages(df).collect()
    key = lambda d: (d is not None, d or 0)
    texts = defaultdict(set)
    for d, t in rows:
        texts[d].add((t or "").encode())
    for x in got:  # each span stands whole in one text of its document, every 64 bytes of it a repeat
        assert x.n_bytes >= MIN_BYTES and key(x.first_doc_id) <= key(x.doc_id)
        assert any(len(t) >= x.start_byte + x.n_bytes and t[x.start_byte:x.start_byte + x.n_bytes].decode() for t in texts[x.doc_id])
    spans = {(x.doc_id, x.start_byte, x.n_bytes, x.first_doc_id) for x in got}
    assert (203, 0, 128, 202) in spans and not {200, 201, 202} & {x.doc_id for x in got}
    assert {x.doc_id for x in got} >= {d for d, *_ in brute(rows, MIN_BYTES)}
    assert whole_passages(df.limit(0)).count() == 0


def test_ends_follow_the_longest_earlier_place(spark):
    """300 passages of 140 bytes in two documents each, whose inner 100 bytes stand earlier elsewhere."""
    from millrace.llm.chunk_dedup import whole_passages
    r = random.Random(77)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = []
    for i in range(300):
        inner = letters(100)
        passage = letters(20) + inner + letters(20)
        rows += [(i, letters(50) + inner + letters(50)), (1000 + i, letters(60) + passage + letters(60)), (2000 + i, letters(70) + passage + letters(40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: x for x in whole_passages(df).collect()}
    assert sorted(got) == [2000 + i for i in range(300)]
    assert all(x.start_byte <= 70 and x.start_byte + x.n_bytes >= 210 and x.n_bytes < 150 for x in got.values())


def test_ends_are_the_longest_by_brute_force(spark):
    """No row could be longer: a byte more beside its first or last block stands at no earlier place."""
    from millrace.llm.chunk_dedup import BLOCK, anchors, whole_passages
    r = random.Random(78)
    pool = ["".join(r.choice("abcd ") for _ in range(220)) for _ in range(5)]
    rows = [(i, "".join(r.choice("abcdefgh") for _ in range(r.randrange(40))) + "".join(r.choice(pool)[:r.randrange(90, 221)] for _ in range(2))) for i in range(60)]
    raw = {d: t.encode() for d, t in rows}
    found = whole_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(found) > 40
    blocks = {d: set(anchors(arr(t)).tolist()) for d, t in raw.items()}

    def earlier(part, shift, d, at):
        return any((e, x + shift) < (d, at) and x + shift in blocks[e] for e, t in raw.items() if e <= d
                   for x in range(len(t) - len(part) + 1) if t[x:x + len(part)] == part)
    for x in found:
        low, high, t = x.start_byte, x.start_byte + x.n_bytes, raw[x.doc_id]
        inside = sorted(a for a in blocks[x.doc_id] if low <= a and a + BLOCK <= high and earlier(t[a:a + BLOCK], 0, x.doc_id, a))
        heads, tails = [a for a in inside if a < inside[0] + BLOCK], [a for a in inside if a > inside[-1] - BLOCK]
        assert any(earlier(t[low:a + BLOCK], a - low, x.doc_id, a) for a in heads) and any(earlier(t[a:high], 0, x.doc_id, a) for a in tails)
        assert low == 0 or not any(a - low < BLOCK and earlier(t[low - 1:a + BLOCK], a - low + 1, x.doc_id, a) for a in heads)
        assert high == len(t) or not any(high - a < 2 * BLOCK and earlier(t[a:high + 1], 0, x.doc_id, a) for a in tails)


def test_anchors_of_a_batch_are_those_of_each_text():
    from millrace.llm.chunk_dedup import anchors, anchors_of
    r = np.random.default_rng(8)
    sizes = [0, 5, 126, 127, 128, 0, 300, 5000, 126, 64, 2000, 0]
    texts = [r.integers(97, 97 + k % 4 + 1, n).astype(np.uint8) for k, n in enumerate(sizes)]
    offsets = np.r_[0, np.cumsum(sizes)]
    want = [o + a for o, t in zip(offsets, texts) for a in anchors(t).tolist()]
    assert anchors_of(np.concatenate(texts), offsets).tolist() == want and len(want) > 50
    assert not len(anchors_of(np.zeros(0, np.uint8), np.zeros(2, np.int64)))


def test_block_digests_are_murmur():
    from millrace.llm.chunk_dedup import BLOCK, block_digests
    m = (1 << 64) - 1

    def murmur(b):
        turn = lambda x, k: (x << k | x >> (64 - k)) & m
        h1 = h2 = 0
        for k in range(0, len(b), 16):
            x, y = (int.from_bytes(b[k + j:k + j + 8], "little") for j in (0, 8))
            h1 = ((turn(h1 ^ turn(x * 0x87C37B91114253D5 & m, 31) * 0x4CF5AD432745937F & m, 27) + h2) * 5 + 0x52DCE729) & m
            h2 = ((turn(h2 ^ turn(y * 0x4CF5AD432745937F & m, 33) * 0x87C37B91114253D5 & m, 31) + h1) * 5 + 0x38495AB5) & m
        h1, h2 = h1 ^ len(b), h2 ^ len(b)
        h1 = (h1 + h2) & m
        h2 = (h2 + h1) & m
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h1, h2 = ((h ^ h >> 33) * c & m for h in (h1, h2))
        h1, h2 = (h ^ h >> 33 for h in (h1, h2))
        h1 = (h1 + h2) & m
        return h1, (h2 + h1) & m

    data = np.random.default_rng(3).integers(0, 256, 500).astype(np.uint8)
    at = np.array([0, 1, 77, 436])
    got = [tuple(int(x) & m for x in h) for h in zip(*block_digests(data, at))]
    assert got == [murmur(data[s:s + BLOCK].tobytes()) for s in at]
