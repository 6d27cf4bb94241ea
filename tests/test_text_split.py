import hashlib

from pyspark.sql import functions as F

from millrace.config import SplitConfig
from millrace.functions.text import py_strip
from millrace.operators.split import resolve_split_source, split_texts, with_split, with_text

EDGE = [None, "   ", "\t x\u3000", "\u0085y\u001c", "\u200bz\ufeff", " a b ", "", "\n\nq\n", "\u00a0n\u2003"]


def test_py_strip_matches_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(EDGE)], "i int, s string")
    got = {r.i: r.t for r in df.select("i", py_strip("s").alias("t")).collect()}
    for i, s in enumerate(EDGE):
        assert got[i] == (None if s is None else s.strip()), (i, s)


def test_extract_text_fields(spark):
    df = spark.createDataFrame([(1, " hi ", ""), (2, None, None), (3, "", "  x"), (4, "a", None)],
                               "n int, t1 string, t2 string")
    got = {r.n: r.text_x for r in with_text(df, ["t1", "t2", "n"]).collect()}
    assert got == {1: "hi\n1", 2: "2", 3: "x\n3", 4: "a\n4"}
    got2 = {r.n: r.text_x for r in with_text(df, ["t1", "t2"]).collect()}
    assert got2 == {1: "hi", 2: None, 3: "x", 4: "a"}


def _u(seed, key):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF


def test_split_hash_matches_reference_formula(spark):
    rows = [(i, f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string")
    out = with_split(with_text(df, ["text"]), SplitConfig(0.3, 7)).collect()
    for r in out:
        u = _u(7, r.id)
        assert abs(r.u - u) < 1e-15
        assert r.split == ("val" if u < 0.3 else "train")


def test_stable_key_fallbacks(spark):
    df = spark.createDataFrame([(None, "u1", "text a"), (0, None, "b"), (None, None, "  ")],
                               "id long, uuid string, text string")
    keys = [r.split_key for r in with_split(with_text(df, ["text"])).orderBy("text").collect()]
    assert sorted(keys) == ["", "0", "u1"]      # null id falls to uuid; id 0 kept; no text -> ""
    no_id = spark.createDataFrame([("hello",), (None,)], "text string")
    got = sorted((r.split_key for r in with_split(with_text(no_id, ["text"])).collect()), key=str)
    assert got == ["", "hello"]


def test_fraction_zero_and_one(spark):
    df = spark.createDataFrame([(i, "x") for i in range(50)], "id long, text string")
    zero = split_texts(df, SplitConfig(0.0, 1), key_col="id")
    assert zero.where("split = 'val'").count() == 0
    one = split_texts(df, SplitConfig(1.0, 1), key_col="id")
    assert one.where("split = 'train'").count() == 0


def test_resolve_split_source(spark):
    train = spark.createDataFrame([(i, f"t{i}") for i in range(100)], "id long, text string")
    val = spark.createDataFrame([(1, "v")], "id long, text string")
    assert resolve_split_source("val", train, val).count() == 1
    assert resolve_split_source("train", train, val).count() == 100
    assert resolve_split_source("test", train) is None
    n_val = resolve_split_source("val", train, cfg=SplitConfig(0.5, 3)).count()
    n_train = resolve_split_source("train", train, cfg=SplitConfig(0.5, 3)).count()
    assert n_val + n_train == 100 and 0 < n_val < 100
    assert F is not None
