import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from millrace import jobs


def test_dedup_job_writes_stages_and_matches_entry(spark, tmp_path):
    out = str(tmp_path / "dedup")
    jobs.main(["dedup", "--input", "/root/testdata/sf0.001/documents.parquet", "--out", out])
    snap = spark.read.parquet(f"{out}/stages/05_snapshot")
    assert sorted(r.id for r in snap.select("id").collect()) == sorted(r.id for r in E.entry(spark).select("id").collect())
    manifest = spark.read.json(f"{out}/manifest").collect()[0]
    assert manifest.status == "finished"


def test_tokenize_and_samples_jobs(spark, tmp_path):
    """Named validation and test sources, no default cut, and samples of every kind from the shards."""
    base = "/root/testdata/sf0.001"
    small = str(tmp_path / "docs")
    spark.read.parquet(f"{base}/documents.parquet").where("n_chars < 900").limit(40).write.parquet(small)
    bench = str(tmp_path / "bench")
    spark.read.parquet(f"{base}/benchmark.parquet").withColumnRenamed("item_id", "doc_id").limit(6).write.parquet(bench)
    out = str(tmp_path / "tok")
    jobs.main(["tokenize", "--input", small, "--out", out, "--vocab-size", "120", "--raw-bin", "--val-split", "held", "--test-split", "held",
               "--split", f"held={bench}"])
    shards = spark.read.parquet(f"{out}/shards")
    assert {r.split: r.n for r in shards.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 40, "val": 6, "test": 6}
    stats = {r.split: r for r in spark.read.json(f"{out}/split_stats").collect()}
    total = shards.where("split = 'train'").agg(F.sum(F.size("tokens"))).first()[0]
    assert stats["train"].tokens == total and stats["test"].samples == 6
    n = {m: None for m in ("padded", "packed", "windowed")}
    for mode in n:
        jobs.main(["samples", "--input", f"{out}/shards", "--out", str(tmp_path / "samples"), "--mode", mode, "--seq-len", "16", "--stride", "8", "--batch-size", "4"])
        t = spark.read.parquet(f"{tmp_path}/samples/{mode}")
        n[mode] = t.where("split = 'train'").count()
        if mode != "padded":
            assert t.where((F.size("input_ids") != 16) | (F.size("labels") != 16)).count() == 0
    assert n == {"padded": 40, "packed": total // 17, "windowed": (total - 17) // 8 + 1}


def test_split_guards():
    from millrace.config import SplitConfig
    from millrace.operators.split import check_split_plan, split_path
    with pytest.raises(ValueError, match="no path"):
        split_path({"train": "x"}, "validation")
    with pytest.raises(ValueError, match="validation"):
        check_split_plan(SplitConfig(val_fraction=0.0), False, 10)
    check_split_plan(SplitConfig(val_fraction=0.0), True, 10)
    check_split_plan(SplitConfig(val_fraction=0.0), False, None)


def test_diagnostics_job(spark, tmp_path):
    from millrace.plans import runlog as b
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    b.run_log(ev).write.parquet(str(tmp_path / "log"))
    b.runs(ev).write.parquet(str(tmp_path / "runs"))
    jobs.main(["diagnostics", "--run-log", str(tmp_path / "log"), "--runs", str(tmp_path / "runs"), "--out", str(tmp_path / "diag")])
    got = spark.read.option("header", True).csv(str(tmp_path / "diag"))
    want = E.queries()["g7_pivot_metrics"](spark, "/root/testdata/sf0.001")
    assert got.count() == want.count() > 0 and {"change", "layer", "step"} <= set(got.columns)
