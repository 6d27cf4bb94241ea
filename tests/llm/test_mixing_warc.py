import base64
import hashlib
import math
import re

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        t = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if t[s] > 2 * sizes[s]}
        if not over:
            return {**{s: 2 * sizes[s] for s in capped}, **t}
        capped |= over


def check(rows, docs):
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(re.findall("[^\x20\x09-\x0d]+", text or ""))
    want = brute_targets(sizes)
    assert len(rows) == len(docs)
    for s in sizes:
        mine = [r for r in rows if r.source == s]
        largest = max(r.size for r in mine)
        assert all(r.source_size == sizes[s] and math.isclose(r.target, want[s], abs_tol=1e-6) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= largest
        assert all(0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in mine)


def test_mix_on_odd_rows(spark):
    from millrace.llm.mixing import mix, quality_weights
    docs = [(i, "w " * (i % 9 + 1), ["a", "b", None, "é", "z"][i * i % 5]) for i in range(200)]
    docs += [(300, None, "empty"), (301, "", "empty"), (302, "one", "big"), (303, "x " * 5000, "big"), (1, "w w", "b"), (1, "w w", "b"), (None, "n n", "a")]
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, source string, size int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    out = mix(df, quality_weights(labels))
    rows = out.collect()
    check(rows, docs)
    assert sorted(rows, key=repr) == sorted(mix(df.repartition(7), quality_weights(labels)).collect(), key=repr)
    assert mix(df.limit(0), quality_weights(labels)).count() == 0


def test_mix_buckets_do_not_change_the_result(spark, monkeypatch):
    from millrace.llm import mixing
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = sorted(mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    assert sorted(mixing.mix(docs).collect()) == whole
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(mixing.mix(docs).collect()) == whole


def test_mix_equals_the_oracle(spark):
    from millrace.llm.queries import ORACLES, QUERIES
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES["op8_mixing"](spark, SF)
    want = con.execute(ORACLES["op8_mixing"])
    names = [d[0] for d in want.description]
    assert names == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def brute_pages(rows):
    last = {}
    for p, html in rows:
        if p is not None:
            last[html or ""] = max(p, last.get(html or "", p))
    out = []
    for p, html in rows:
        h = html or ""
        d = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        again = h in last and last[h] != p
        out.append((p, len(h.encode()), d, "revisit" if again else "response", last[h] if again else None))
    return sorted(out, key=repr)


COLS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_warc_round_trip(spark):
    from millrace.llm.warc import round_trip
    rows = [(i, "pé " * (i % 7)) for i in range(100)] + [(200, None), (201, ""), (None, "only null"), (202, "x" * 300_000), (203, "a\r\n\r\nWARC/1.1\r\n"), (203, "a\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(a, "u\nv" if a and a % 2 else None, b, "r") for a, b in rows], "page_id long, url string, html string, sha1 string")
    out = round_trip(df)
    assert sorted(map(tuple, out.select(COLS).collect()), key=repr) == brute_pages(rows)
    texts = {r.page_id: r.payload for r in out.where("record_type = 'response'").collect()}
    assert bytes(texts[202]) == b"x" * 300_000
    assert round_trip(df.limit(0)).count() == 0


def test_warc_on_the_given_pages(spark):
    from millrace.llm.queries import QUERIES
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    out = QUERIES["op9_warc"](spark, SF)
    assert out.columns == COLS and sorted(map(tuple, out.collect()), key=repr) == brute_pages(rows)


def test_warc_dictionary_and_faults():
    import struct

    import zstandard
    from millrace.llm.warc import DICTIONARY_MAGIC, parse_record, read_frames, record
    recs = [record(i, f"http://x/{i}", b"<p>hello %d</p>" % i, hashlib.sha1(b"<p>hello %d</p>" % i).digest(), None, "d") for i in range(300)]
    trained = zstandard.train_dictionary(4096, recs)
    c = zstandard.ZstdCompressor(dict_data=trained, write_checksum=True)
    frames = [c.compress(r) for r in recs]
    for raw in (trained.as_bytes(), zstandard.ZstdCompressor().compress(trained.as_bytes())):
        data = struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw + b"".join(frames)
        assert list(read_frames(data)) == recs
        for broken in (data[:-3], data[:20], data + b"junk", data[:-1] + bytes([data[-1] ^ 1])):
            with pytest.raises((ValueError, zstandard.ZstdError)):
                list(read_frames(broken))
    assert parse_record(recs[5])[0] == 5
    for broken in (recs[5].replace(b"hello", b"hallo"), recs[5] + b"\r\n", recs[5].replace(b"WARC/1.1", b"WARC/1.0"), recs[5].replace(b"Content-Length: 1", b"Content-Length: 2")):
        with pytest.raises(ValueError):
            parse_record(broken)
