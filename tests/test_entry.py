"""The driver contract, and the SQL oracles on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "labels", "events", "part", "conversations"]
FAST = ["b2_prefix_samples", "b5_extract_text", "b7_assign_split", "b9_seeded_shuffle", "b10_extract_sentences",
        "b13_batch_rows", "e0_global_position", "e7_assign_shards", "e11_pack_blocks", "g3_change_label",
        "g7_pivot_metrics", "g8_run_rollup", "g13_entropy_lower_bound", "d12_quality_report", "d5_candidate_pairs"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["dataset", "id", "instruction", "code_ref", "language", "has_code", "cluster_id"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_oracle_agrees(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(ocols)
    order = sorted(sdf.columns)
    s = sorted((tuple(_norm(r[c]) for c in order) for r in sdf.collect()), key=repr)
    idx = [ocols.index(c) for c in order]
    o = sorted((tuple(_norm(row[i]) for i in idx) for row in cur.fetchall()), key=repr)
    assert s == o
