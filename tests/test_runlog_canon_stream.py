import math
import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import runlog as rl
from millrace.operators.canon import canonicalize, node_types, parse_row

SF = "/root/testdata/sf0.001"


def test_finite_or_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "v double")
    assert [r.x for r in df.select(rl.finite_or_null(F.col("v")).alias("x")).collect()] == [1.0, None, None, None, None]


@pytest.mark.parametrize("v", [0.5, 1.0, 2.5, 0.0, 1e-5, 123456.0, 1234567.0, 0.1 + 0.2, 3.14159265])
def test_format_g_matches_python(spark, v):
    got = spark.range(1).select(rl.format_g(F.lit(v)).alias("s")).first().s
    assert got == "%g" % v


def test_change_label_rules(spark):
    runs = spark.createDataFrame([
        ("r1", "n1", ["qk-init-m-1.0", "qk-init-m-1"], {"config/qk_gain_init": "0.5"}),
        ("r2", "n2", ["qk-init-m-1.0", "qk-init-m-1"], {"config/qk_gain_init": "3"}),
        ("r3", "n3", ["x", "qk-init-m-22", "qk-init-m-9", "qk-init-m-8"], {}),
        ("r4", None, ["a"], {}),
        ("r5", "n5", None, None)], "run_id string, run_name string, tags array<string>, summary map<string,string>")
    got = {r.run_id: r.change for r in rl.change_label(runs).collect()}
    assert got == {"r1": "qk-init-m-0.5", "r2": "3", "r3": "qk-init-m-9", "r4": "r4", "r5": "n5"}


def test_entropy_bounds(spark):
    df = spark.createDataFrame([(0.0, 64), (800.0, 64), (3.0, 2)], "s double, n int")
    h, hn = rl.entropy_lower_bound(F.col("s"), F.col("n"))
    out = df.select(h.alias("h"), hn.alias("hn")).collect()
    assert math.isclose(out[0].h, math.log(64)) and math.isclose(out[0].hn, 1.0)
    assert out[1].h >= 0 and out[1].h < 1e-250
    p = math.exp(3) / (math.exp(3) + 1)
    assert math.isclose(out[2].h, -p * math.log(p) - (1 - p) * math.log(1 - p))


def test_sigma_requires_columns(spark):
    with pytest.raises(ValueError):
        rl.sigma_bounds(spark.createDataFrame([(1.0,)], "head_dim double"))


def test_canonicalize_edge_cases(spark):
    rows = [
        ("ok", "python", True, 'def f(a):\n    """doc"""\n    return a + 1\n'),
        ("syntax", "python", True, "def f(:\n"),
        ("long", "python", True, "x = 1\n" * 40000),
        ("java", "java", True, "class A {}"),
        ("nocode", "python", False, "x = 1"),
        ("null", "python", True, None),
        ("q16", "python", True, "def f():\n    0\n    return 1\n"),
    ]
    df = spark.createDataFrame(rows, "id string, language string, has_code boolean, code_ref string")
    got = {r.id: r for r in canonicalize(df).collect()}
    assert got["ok"].parse_ok and "Expr" not in got["ok"].node_types
    assert got["ok"].node_types[:2] == ["Module", "FunctionDef"]
    assert not got["syntax"].parse_ok and got["syntax"].parse_err.startswith("SyntaxError:")
    assert got["long"].parse_ok and len(got["long"].node_types) == 1 + 40_000 * 4      # no length limit
    assert got["java"].parse_err == got["nocode"].parse_err == "not_python_or_no_code"
    assert got["null"].parse_ok and got["null"].node_types == ["Module"]
    # Q16: a bare 0 becomes "NUM", a str, and is removed as if it were a docstring.
    assert got["q16"].node_types == ["Module", "FunctionDef", "arguments", "Return", "Constant"]


def test_traversals_hold_the_same_nodes():
    code = "class A:\n    'doc'\n    def f(self, x=1):\n        return [y for y in x]\nprint(A().f(2))\n"
    pre, post, bfs = (node_types(code, t) for t in ("preorder", "postorder", "bfs"))
    assert pre[0] == bfs[0] == post[-1] == "Module" and sorted(pre) == sorted(post) == sorted(bfs)
    assert pre[1:3] == ["ClassDef", "FunctionDef"] and bfs[1:3] == ["ClassDef", "Expr"]


def test_token_fallback():
    ok, err, rep = parse_row("x = = 1  # c\n", "preorder", True)          # lexes, does not parse
    # the end marker is not left out, so it stays as literal text ""
    assert ok and err.startswith("SyntaxError_fallback:") and rep == ["NAME", "=", "=", "NUM", ""]
    ok2, err2, rep2 = parse_row("x = (1, 'a'\n", "preorder", True)         # unbalanced: lexing fails too
    assert ok2 and rep2 == ["x", "=", "(1,", "'a'"]
    ok3, _, rep3 = parse_row("s = 'unterminated\n", "preorder", True)
    assert ok3 and isinstance(rep3, list)
    assert len(parse_row("x = = " + "1 + " * 6000, "preorder", True)[2]) > 12_000   # no cap


def test_ingest_stream_equals_batch(spark, tmp_path):
    from millrace.config import SplitConfig
    from millrace.operators.split import split_texts
    from millrace.streaming.streams import ingest_stream, read_landing
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stream = read_landing(spark, SF, docs.schema, glob="documents.parquet")
    out, ck = os.path.join(tmp_path, "out"), os.path.join(tmp_path, "ck")
    ingest_stream(stream, out, ck, SplitConfig(), key_col="doc_id").awaitTermination()
    got = sorted((r.doc_id, r.split) for r in spark.read.parquet(out).collect())
    want = sorted((r.doc_id, r.split) for r in split_texts(docs, SplitConfig(), key_col="doc_id").collect())
    assert got == want


def test_last_log_row_wins_whole(spark):
    """Null steps, two rows per layer and step, non-finite values, history without diagnostics."""
    nan, inf = float("nan"), float("inf")
    a = "attention_diagnostics/layer_"
    log = [("r1", 0, {f"{a}2/x": 1.0, f"{a}2/y": 2.0, "_step": 5.0}), ("r1", 1, {f"{a}2/x": 3.0, "_step": 5.0}),
           ("r1", 2, {f"{a}10/x": nan, f"{a}10/z": inf, "train/step": 4.0}), ("r1", 3, {f"{a}10/x": 7.0}), ("r1", 4, {"train/loss": 1.0, "_step": 9.0}),
           ("r2", 5, {"train/loss": 1.0, "_step": 1.0})]
    df = spark.createDataFrame(log, "run_id string, log_pos long, metrics map<string,double>")
    long = rl.unpivot_diagnostics(df, keep_position=True)
    assert sorted((r.layer, r.metric, r.value) for r in long.where("log_pos = 2").collect()) == [(10, "x", None), (10, "z", None)]
    got = sorted(map(tuple, rl.latest_per_layer(long).collect()), key=repr)
    assert got == [("r1", 5, 2, "x", 3.0), ("r1", None, 10, "x", 7.0)]      # whole rows: no y, no z
    runs = spark.createDataFrame([(r, {"_step": "8", f"{a}1/x": "0.5", f"{a}1/y": "NaN", "other": "1"}) for r in ("r1", "r2", "r3")],
                                 "run_id string, summary map<string,string>")
    fall = sorted(map(tuple, rl.summary_fallback(runs, long).collect()), key=repr)
    assert fall == [("r2", 8, 1, "x", 0.5), ("r2", 8, 1, "y", None), ("r3", 8, 1, "x", 0.5), ("r3", 8, 1, "y", None)]
    one = rl.latest_per_layer(rl.unpivot_diagnostics(df.drop("log_pos"), keep_position=True))
    assert {(r.layer, r.step) for r in one.collect()} == {(2, 5), (10, 4)}   # without a log position a step beats none


def test_rollup_and_monitor_flag_non_finite(spark, tmp_path):
    from millrace.streaming.streams import latest_monitor, monitor_aggregates, monitor_stream
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1, 1.0, 2.0, 0.5, 10), ("a", 2, None, 1.5, None, None), ("b", 1, nan, None, 0.1, 5), ("c", 1, 1.0, None, inf, 5), ("d", 1, None, None, None, 1)]
    schema = "run_id string, step long, train_loss double, val_loss double, grad_norm double, tokens long"
    steps = spark.createDataFrame(rows, schema)
    assert {r.run_id: r.had_nan for r in rl.run_rollup(steps, 10).collect()} == {"a": False, "b": True, "c": True, "d": False}
    want = sorted(map(tuple, monitor_aggregates(steps).collect()))
    assert {r[0]: r[4] for r in want} == {"a": False, "b": True, "c": True, "d": False}
    src, out, ck = (os.path.join(tmp_path, x) for x in ("src", "out", "ck"))
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        monitor_stream(spark.readStream.schema(schema).parquet(src), out, ck).awaitTermination()
    assert sorted(map(tuple, latest_monitor(spark, out).collect())) == want


def _diagnostics(spark, log):
    runs = spark.createDataFrame([("r1", "n1", "finished", [], {}), ("r2", "n2", "failed", [], {"_step": "3", "attention_diagnostics/layer_0/x": "0.5"})],
                                 "run_id string, run_name string, state string, tags array<string>, summary map<string,string>")
    return rl.diagnostics_table(runs, spark.createDataFrame(log, "run_id string, metrics map<string,double>").repartition(3), all_steps=True)


def test_all_steps_keeps_every_log_row(spark):
    """Two log rows of one step (two of them equal) are rows of their own; a run without history has its summary."""
    a = "attention_diagnostics/layer_"
    log = [("r1", {f"{a}2/x": 1.0, f"{a}2/y": 2.0, f"{a}10/x": 9.0, "_step": 5.0}), ("r1", {f"{a}2/x": 3.0, "_step": 5.0}), ("r1", {f"{a}2/x": 3.0, "_step": 5.0}),
           ("r1", {f"{a}2/y": float("nan")}), ("r1", {"train/loss": 1.0, "_step": 6.0})]
    wide = rl.pivot_metrics(_diagnostics(spark, log))
    assert wide.columns == [*rl.LEADING, "x", "y"]
    got = [(r.run_id, r.layer, r.step, r.x, r.y) for r in wide.collect()]
    assert sorted(got, key=repr) == sorted([("r1", 2, 5, 1.0, 2.0), ("r1", 10, 5, 9.0, None), ("r1", 2, 5, 3.0, None), ("r1", 2, 5, 3.0, None),
                                            ("r1", 2, None, None, None), ("r2", 0, 3, 0.5, None)], key=repr)


def test_too_many_metric_names_fail_early(spark):
    log = [("r1", {f"attention_diagnostics/layer_0/m{k}": 1.0 for k in range(i, i + 100)}) for i in range(0, 10_000, 100)]
    with pytest.raises(ValueError, match="more than 2000 metric names"):
        rl.pivot_metrics(_diagnostics(spark, log))
    assert len(rl.pivot_metrics(_diagnostics(spark, log), ["m1", "m9999"]).columns) == 8


def test_streams_over_tables_of_one_file_and_of_a_folder(spark, tmp_path):
    from millrace.plans.catalog import QUERIES
    docs = spark.createDataFrame([(i, f"text {i}", "en", "web", 6) for i in range(40)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(f"{tmp_path}/many/documents.parquet")
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    want = {(i, f"text {i}") for i in range(40)}
    for folder in (tmp_path, tmp_path / "many"):
        assert {(r["doc_id"], r["text_x"]) for r in QUERIES["st1_ingest_stream"](spark, str(folder)).collect()} == want
