import json

import pytest

from millrace.sources import corpus as cs

SF = "/root/testdata/sf0.001"


def test_manifest_and_observed_write(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    back, metrics = cs.observed_write(docs, str(tmp_path / "stage"), "docs")
    assert metrics["rows_processed"] == back.count() == 200
    m = cs.write_manifest(spark, str(tmp_path / "manifest"), "r1", "finished", 0.0, [metrics], {"a": "b"})
    row = m.collect()[0]
    assert row.run_id == "r1" and json.loads(row.stages)[0]["rows_processed"] == 200


def test_jsonl_reader_fails_fast_and_needs_files(spark, tmp_path):
    d = tmp_path / "j"
    d.mkdir()
    (d / "a.jsonl").write_text('\n{"text": "x"}\n\n{"text": "y"}\n')
    assert sorted(r.text for r in cs.read_jsonl_corpus(spark, str(d), "text string").collect()) == ["x", "y"]
    (d / "b.jsonl").write_text('{"text": \n')
    with pytest.raises(Exception):
        cs.read_jsonl_corpus(spark, str(d), "text string").collect()
    empty = tmp_path / "e"
    empty.mkdir()
    with pytest.raises(Exception):
        cs.read_jsonl_corpus(spark, str(empty), "text string")


def test_raw_shards_rewrite_and_ranges(spark, tmp_path, monkeypatch):
    """A rewrite with fewer shards leaves no old ones; long shards are read in ranges, in order."""
    from millrace.sources import tokenshards as ts
    path = str(tmp_path / "bin")

    def rows(n_shards, n):
        return spark.createDataFrame([("train", s, p, [s * 1000 + p, p % 7] * n) for s in range(n_shards) for p in range(5)] + [("val", 0, 0, [])],
                                     "split string, shard int, pos long, tokens array<int>")

    ts.write_raw_shards(rows(5, 10), path)
    assert ts.read_raw_shards(spark, path).select("shard").distinct().count() == 5
    ts.write_raw_shards(rows(2, 60_000), path, "uint32")
    back = ts.read_raw_shards(spark, path, "uint32").collect()
    for s in (0, 1):
        got = [t for r in sorted((r for r in back if r.shard == s), key=lambda r: r.chunk) for t in r.tokens]
        assert got == [t for p in range(5) for t in [s * 1000 + p, p % 7] * 60_000]
    assert {r.shard for r in back} == {0, 1}
    assert sorted(p.name for p in (tmp_path / "bin").rglob("*") if p.is_file() and not p.name.startswith(".")) == ["train_000000.bin", "train_000001.bin", "val_000000.bin"]
    assert not (tmp_path / "bin" / "_attempt").exists()


def test_parquet_shards_round_trip(spark, tmp_path):
    from millrace.sources import tokenshards as ts
    df = spark.createDataFrame([("train", s, p, f"d{s}{p}", [s, p, 65_535]) for s in range(3) for p in range(4)] + [("val", 0, 0, "v", [])],
                               "split string, shard int, pos long, doc_id string, tokens array<int>")
    back = ts.write_parquet_shards(df, str(tmp_path / "pq"))
    cols = ["split", "shard", "pos", "doc_id", "tokens"]
    key = lambda x: sorted(map(str, x.select(cols).collect()))
    assert key(back) == key(df) and {r.dtype for r in back.collect()} == {"uint16"}
    again = ts.write_parquet_shards(df.where("shard = 0"), str(tmp_path / "pq"))
    assert again.select("shard").distinct().count() == 1
