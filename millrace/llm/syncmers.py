"""Document fingerprints from closed syncmers (DataFrame functions only).

A text's units are its words, words over 16 code points in pieces of 16. A window of ``K``
units is a closed syncmer when the least hash among its inner windows of ``S`` units is that
of the first or the last one. Whether a window is chosen depends on its own units alone, so
an edit changes the choice only of windows that touch it (context-free anchors), and the
anchors of two texts can be matched with their positions (``matched_anchors``).

The fingerprint holds the ``SKETCH`` least anchor hashes of a text, 8 hex digits each and
ascending; a text without a chosen window (fewer than ``K`` units, or ``K`` or a few more with
none) has one anchor of all its units, and only one without units the empty fingerprint. Likeness estimates the Jaccard likeness of the anchor sets from
the least hashes of their union, 1 for equal fingerprints and 0 where one is empty.

Rows: one per input row. Null text counts as empty. The next document is that with the next
(doc_id, text), null ids first and the first one after the last; so among repeated ids the
texts decide, and a single document follows itself. An empty table gives an empty one. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import as_text, n_buckets
from millrace.llm.native import indices, let

K, S = 5, 2
UNIT = "[^\\x20\\x09-\\x0D]{1,16}"
SKETCH = 128


def anchors(text: Column) -> Column:
    """array<struct<pos int, hash bigint>>: the closed syncmers, ``pos`` the first unit's number."""
    # For K = 5 and S = 2 an anchor's hash follows from the inner windows at 0 and 2 and the last unit.
    def chosen(h: Column) -> Column:
        inner = F.transform(indices(F.size(h) - (S - 1)), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)))

        def closed(m: Column) -> Column:
            def one(i: Column) -> Column:
                first, last = F.get(m, i), F.get(m, i + (K - S))
                edge = F.least(first, last) <= F.least(*[F.get(m, i + d) for d in range(1, K - S)])
                return F.when(edge, F.struct(i.alias("pos"), F.xxhash64(first, F.get(m, i + 2), F.get(h, i + 4)).alias("hash")))
            return F.filter(F.transform(indices(F.size(h) - (K - 1)), one), lambda x: x.isNotNull())

        short = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(h).alias("hash")))
        return (F.when(F.size(h) == 0, F.array().cast("array<struct<pos:int,hash:bigint>>"))
                 .when(F.size(h) < K, short).otherwise(let(let(inner, closed), lambda c: F.when(F.size(c) == 0, short).otherwise(c))))

    units = F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))
    return let(F.transform(units, lambda u: F.xxhash64(u)), chosen)


def sketch(text: Column, size: int = SKETCH) -> Column:
    """array<bigint>: the least ``size`` distinct anchor hashes, as 32-bit values, ascending."""
    hashes = F.transform(anchors(text), lambda a: F.shiftrightunsigned(a["hash"], 32))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def fingerprint(sk: Column) -> Column:
    return F.array_join(F.transform(sk, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    """Share of the least hashes of the union that both sketches hold."""
    both = let(F.slice(F.sort_array(F.array_union(a, b)), 1, size),
               lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both)


def matched_anchors(left: Column, right: Column) -> Column:
    """array<struct<left_pos, right_pos, hash>>: anchors of ``left`` with the first equal one of ``right``."""
    def join(r: Column) -> Column:
        where = F.map_from_entries(F.transform(F.array_distinct(F.transform(r, lambda x: x["hash"])),
                                               lambda h: F.struct(h, F.array_min(F.transform(F.filter(r, lambda x: x["hash"] == h), lambda x: x["pos"])))))
        return let(where, lambda w: F.transform(F.filter(left, lambda x: F.map_contains_key(w, x["hash"])),
                                                lambda x: F.struct(x["pos"].alias("left_pos"), w[x["hash"]].alias("right_pos"), x["hash"].alias("hash"))))
    return let(right, join)


def with_next(docs: DataFrame, cols: tuple[str, ...], buckets: int | None = None) -> DataFrame:
    """Adds ``next_<c>`` for each of ``cols``: the value of the next row in the order of
    (__key, text), cyclic. ``docs`` has a bigint ``__key`` without nulls.

    Rows are dealt to buckets of key ranges (bounds: approximate quantiles, so the buckets are
    even also where ids are not); within a bucket the next row is a window's lead. Each
    bucket's least rows also go to the bucket before, marked, and are dropped after the lead."""
    n = buckets or n_buckets(docs)
    cuts = docs.agg(F.percentile_approx("__key", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    if cuts:
        steps = max(1, len(cuts)).bit_length() + 1
        bounds = F.array(*[F.lit(c).cast("bigint") for c in cuts])
        # Number of bounds up to the key, by halving.
        halved = lambda a, _: let(F.floor((a["lo"] + a["hi"]) / 2).cast("int"), lambda m: F.when(a["lo"] >= a["hi"], a).when(
            F.get(bounds, m) <= F.col("__key"), F.struct((m + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), m.alias("hi"))))
        bucket = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), halved, lambda a: a["lo"])
    else:
        bucket = F.lit(0)
    heads = docs.select("__key").withColumn("b", bucket).groupBy("b").agg(F.min("__key").alias("k")).orderBy("b").collect()  # a row per bucket
    before = [(h["k"], heads[i - 1]["b"], i == 0) for i, h in enumerate(heads)]
    marks = F.broadcast(docs.sparkSession.createDataFrame(before, "__h_key bigint, __h_bucket int, __wrap boolean"))  # a row per bucket
    rows = docs.withColumn("__bucket", bucket).join(marks, F.col("__key") == F.col("__h_key"), "left")
    own = F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("mark"), F.lit(False).alias("wrap"))
    marked = F.struct(F.col("__h_bucket").alias("b"), F.lit(True).alias("mark"), F.col("__wrap").alias("wrap"))
    rows = rows.withColumn("__to", F.explode(F.when(F.col("__h_key").isNotNull(), F.array(own, marked)).otherwise(F.array(own))))
    order = Window.partitionBy("__to.b").orderBy("__to.wrap", "__key", "text")
    return (rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in cols}).where(~F.col("__to.mark"))
                .drop("__bucket", "__h_key", "__h_bucket", "__wrap", "__to"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, sketch)`` for every document."""
    return docs.select("doc_id", as_text().alias("text")).withColumn("sketch", sketch(F.col("text")))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprints of each document and of its edited text, with their likeness and that
    to the next document: ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next)``."""
    rows = fingerprints(docs).withColumn("__key", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)).cast("bigint")))
    rows = with_next(rows, ("text", "sketch"))
    n = F.char_length("text")
    m = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - m), F.substring("next_text", F.lit(1), m)))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch",
                       sketch(F.col("edited")).alias("edited_sketch"))
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
                       likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
