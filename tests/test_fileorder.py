"""B2 and B9 by file order, over several files."""

import os

import pytest

from millrace.operators import fileorder as fo


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """Files whose order by parts differs from that by name; one is empty, one has a space in its name."""
    base = tmp_path_factory.mktemp("files")
    at = 0
    for name, n in (("a/x.parquet", 5), ("a/y z+1.parquet", 7), ("a.parquet", 3), ("b/c/d.parquet", 4), ("b/e.parquet", 0), ("b/f.parquet", 6)):
        path = os.path.join(base, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        spark.range(at, at + n).selectExpr("id AS k", "concat('t', id) AS text").toPandas().to_parquet(path)
        at += n
    return str(base)


def test_positions_follow_paths_and_rows(spark, root):
    placed = _recursive(spark, root)
    got = sorted((r.pos, r.k, r.file) for r in fo.file_positions(placed).collect())
    assert [k for _, k, _ in got] == list(range(25)) and [p for p, _, _ in got] == list(range(25))
    assert {f for _, _, f in got} == {"a/x.parquet", "a/y z+1.parquet", "a.parquet", "b/c/d.parquet", "b/f.parquet"}


def _recursive(spark, root):
    return fo.read_placed(spark, root, recursive=True)


@pytest.mark.parametrize("listed", [fo.LISTED_FILES, 0])
def test_prefix_samples(spark, root, monkeypatch, listed):
    monkeypatch.setattr(fo, "LISTED_FILES", listed)
    placed = _recursive(spark, root)
    with pytest.warns(UserWarning, match="only 25 rows for a sample of 100"):
        out = fo.file_prefix_samples(placed, [100, 9, 2]).collect()
    assert sorted((r.sample_size, r["rank"], r.k) for r in out) == [(s, i + 1, i) for s in (2, 9, 100) for i in range(min(s, 25))]


def test_prefix_reads_the_first_files_only(spark, root):
    placed = _recursive(spark, root)
    plan = fo.file_prefix_samples(placed, [4])
    assert {r.file for r in plan.collect()} == {"a/x.parquet"}
    assert "a/x.parquet" in plan._jdf.queryExecution().toString() and "b/f.parquet" not in plan._jdf.queryExecution().toString()


def test_no_rows_is_an_error(spark, tmp_path):
    spark.range(0).selectExpr("id AS k").write.parquet(str(tmp_path / "none"))
    with pytest.raises(ValueError, match="no rows"):
        fo.file_prefix_samples(fo.read_placed(spark, str(tmp_path / "none")), [3])


def test_file_shuffle_moves_files_whole(spark, root):
    placed = _recursive(spark, root)
    orders = set()
    for seed in range(6):
        rows = sorted((r.pos, r.file, r.row) for r in fo.file_positions(placed, fo.by_hash(seed)).collect())
        files = list(dict.fromkeys(f for _, f, _ in rows))
        assert len(files) == 5 and [p for p, _, _ in rows] == list(range(25))
        assert [(f, r) for _, f, r in rows] == [(f, r) for f in files for r in sorted(x for _, g, x in rows if g == f)]
        orders.add(tuple(files))
    assert len(orders) > 2 and [fo.role_seed(42, r) for r in ("train", "val", "test")] == [43, 44, 45]


def test_json_lines_in_gzip_files(spark, tmp_path):
    import gzip
    for f in range(3):
        with gzip.open(tmp_path / f"p{f}.json.gz", "wt") as out:
            out.writelines(f'{{"k": {f * 100 + i}}}\n' for i in range(40))
    placed = fo.read_placed(spark, str(tmp_path), "json", "k long", glob="*.json.gz")
    got = sorted((r.pos, r.k) for r in fo.file_positions(placed).collect())
    assert got == [(f * 40 + i, f * 100 + i) for f in range(3) for i in range(40)]


@pytest.mark.parametrize("buffer", [0, 1, 10, 1000])
def test_buffer_shuffle_is_bounded(spark, buffer):
    rows = {r.pos: r.shuffled_pos for r in fo.buffer_shuffle(spark.range(500).selectExpr("id AS pos"), 3, buffer).collect()}
    assert sorted(rows.values()) == list(range(500))
    if buffer < 2:
        assert all(a == b for a, b in rows.items())
    else:
        assert sum(a != b for a, b in rows.items()) > 300
        order = sorted(rows, key=rows.get)
        reached = -1
        for p in order:                 # nothing stands ``buffer`` or more places before what is behind it
            assert p > reached - buffer
            reached = max(reached, p)


def test_no_task_writes_a_whole_language(spark, tmp_path, monkeypatch):
    from millrace.plans import catalog_tokens as ct
    rows = [(i * 7 % 2000, f"t{i}", None if i % 50 == 0 else "en") for i in range(2000)] + [(9, "again", "en"), (9, "again", "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(ct, "BLOCK_FILES", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for size in (None, 50):
            placed = ct._in_files(spark, str(tmp_path), size)
            files = sorted({r["file"] for r in placed.where("lang = 'en'").select("file").distinct().collect()})
            tasks = {f.split("/")[-1].split("-")[1] for f in files}
            assert len(tasks) > 2
            got = [(r["lang"], r["doc_id"], r["row"]) for r in fo_sorted(placed)]
            want = sorted(((lang, i) for i, _, lang in rows), key=lambda x: (x[0] is None, x))
            assert sorted((x[:2] for x in got), key=repr) == sorted(want, key=repr)
            for lang in ("en", None):
                mine = [x for x in got if x[0] == lang]
                assert [x[1] for x in mine] == sorted(x[1] for x in mine)
                if size:
                    assert [x[2] for x in mine] == [k % size for k in range(len(mine))]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def fo_sorted(placed):
    from millrace.operators.fileorder import file_positions
    return file_positions(placed).orderBy("pos").collect()
