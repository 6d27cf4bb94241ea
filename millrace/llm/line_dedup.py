"""Line dedup by a segment-partition edit join (DataFrame functions only).

Lines are the parts of a text between line breaks. Equal lines are one class; lines of at least
``MIN_CHARS`` characters within ``MAX_EDITS`` edits of each other are linked, and linked lines
are one class too. With ``tiers`` the edits follow the length of the shorter line instead
(``TIERS``): one join per tier, their links together. Of a class the first line by (doc_id, line number) stays, every other is
removed from its text. Lines without a word stay as they are.

The join: a line is split into ``MAX_EDITS + 1`` segments, which an index holds under (length of
the line, number of the segment, text of the segment). Two lines within that many edits share a
segment, near its place: of the longer line only the substrings that can match without a shift
that the edits left over could not undo are looked up, in the index of each length from its own
down. What meets is verified by edit distance within the band of diagonals that the edits allow.

A segment that many lines hold does not give their pairs: first each line found under it meets
the segment's least line only. Where a segment has more lines, those that are not connected by
then meet under finer keys: what stands before and after the segment is split again by the edits
that can still fall there, and one more segment of either side must be shared. Two lines meet once,
under the least key that they share, and only lines whose characters and pairs of neighbouring ones
differ by as much as the edits can change go on to the distance. Equal lines are grouped before
anything is joined.

Rows: one per input row. Null text stays null and has no lines. Rows of one doc_id with equal
texts are one document (their lines go or stay alike), with different texts two documents whose
equal lines at equal line numbers both count as first. A null doc_id comes first. A text that
loses all its lines is empty. An empty table gives an empty one. Names with two underscores in
front are this operator's own. Lines are told apart by two 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise, release
from millrace.llm.native import WHITE, let
from millrace.operators.components import component_roots

MAX_EDITS = 2
MIN_CHARS = 60
#: (edits, characters of the shorter line from, and below), the edits not falling: a segment holds 10 characters at least.
TIERS = ((1, 20, 60), (2, 60, 200), (3, 200, None))
#: Rows of ids that are broadcast at most; more of them are joined by shuffle.
BROADCAST_ROWS = 500_000


def _lines(docs: DataFrame, min_chars: int = 0) -> DataFrame:
    """``(doc_id, th, no, line)`` of the lines with a word, of ``min_chars`` characters or more;
    ``th`` tells texts of one id apart."""
    text = F.col("text").cast("string")
    lines = docs.select(F.col("doc_id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("no", "line"))
    if min_chars:  # most short lines have too few bytes already
        lines = lines.where((F.octet_length("line") >= min_chars) & (F.char_length("line") >= min_chars))
    return lines.where(F.ltrim("line", F.lit(WHITE)) != "")


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are within ``edits`` edits."""
    return F.levenshtein(a, b, edits) >= 0


def _segment(n: Column, i, edits) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 1) of a line of n characters; the last are the longer ones."""
    i, parts = (x if isinstance(x, Column) else F.lit(x) for x in (i, edits + 1))
    short, first_long = F.floor(n / parts).cast("int"), parts - n % parts
    start = 1 + (i - 1) * short + F.greatest(F.lit(0), i - 1 - first_long)
    return start, short + (i > first_long).cast("int")


def _shifts(down: int, i: int, edits: int) -> range:
    """Shifts at which segment i of a line can stand in one longer by ``down``: the edits before it
    and those after it must be able to make them up."""
    return range(max(1 - i, down - (edits + 1 - i)), min(i - 1, down + edits + 1 - i) + 1)


def _codes(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of every lookup; its place in the list is its code."""
    return [(down, i, shift) for down in range(edits + 1) for i in range(1, edits + 2) for shift in _shifts(down, i, edits)]


def _key(wide: Column, n: Column, i: Column, start: Column, size: Column) -> Column:
    """The key of ``size`` characters of a line from ``start`` (from 1) on. ``wide`` holds the line with four bytes
    a character, so that no key walks through the characters before its own."""
    return F.xxhash64(n, i, F.substring(wide, 4 * start - 3, 4 * size))


def entries(wide: Column, n: Column, edits: int) -> Column:
    """array<bigint>: the keys under which a line of n characters stands in the index."""
    return F.array(*[_key(wide, n, F.lit(i), *_segment(n, i, edits)) for i in range(1, edits + 2)])


def probes(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """``(h, key, code)``: the index entries that the lines ``(wide, n, h)`` look up, one a row, those
    left out where the lines looked for would be too short. The codes are a literal table and the key
    is one expression: one for every code makes methods that the JVM does not compile."""
    table = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in (("down", down), ("i", i), ("shift", shift), ("code", code))])
                      for code, (down, i, shift) in enumerate(_codes(edits))])
    down, i, shift = (F.col(f"p.{k}") for k in ("down", "i", "shift"))
    n = F.col("n") - down
    start, size = _segment(n, i, F.lit(edits))
    rows = lines.select("h", "wide", "n", F.explode(table).alias("p")).where((down == 0) | (n >= min_chars))
    return rows.select("h", _key(F.col("wide"), n, i, start + shift, size).alias("key"), F.col("p.code").alias("code"))


def _finer_places(edits: int) -> Column:
    """By code, the segments before and after with their shifts: a literal of fixed size."""
    by_code = []
    for down, i, shift in _codes(edits):
        places = [F.struct(*[F.lit(v).alias(k) for k, v in (("down", down), ("i", i), ("shift", shift), ("a", a), ("oa", oa), ("b", b), ("ob", ob))])
                  for a in range(1, i + 1) for b in range(1, edits + 3 - i)
                  for oa in _shifts(shift, a, i - 1) for ob in _shifts(down - shift, b, edits + 1 - i)]
        by_code.append(F.array(*places) if places else F.filter(F.array(by_code[0][0]), lambda x: F.lit(False)))
    return F.array(*by_code)


def _finer(found: DataFrame, edits: int) -> DataFrame:
    """Rows ``(line, n, key, code, ...)`` with their finer keys, one a row: ``finer``, ``entry`` and ``down``, by how
    much a line under the key is shorter.

    Of two lines within the edits, one pair of equal segments has at most i - 1 edits before it and
    edits + 1 - i after it. What stands before and after is split again by as many edits, and a
    finer key holds one segment of either side. ``entry`` marks the keys under which the line
    itself stands; the others are lookups, with the shifts that those edits allow."""
    rows = found.withColumn("f", F.explode(F.get(_finer_places(edits), F.col("code"))))
    down, i, shift, a, oa, b, ob = (F.col(f"f.{k}") for k in ("down", "i", "shift", "a", "oa", "b", "ob"))
    rows = rows.withColumn("f_at", F.struct(*[c.alias(k) for k, c in zip(("start", "size"), _segment(F.col("n") - down, i, F.lit(edits)))]))
    start, size = F.col("f_at.start"), F.col("f_at.size")      # of the line in the index
    rows = rows.withColumn("f_len", F.struct((start - 1).alias("before"), (F.col("n") - down - start - size + 1).alias("after")))
    (pa, la), (pb, lb) = _segment(F.col("f_len.before"), a, i - 1), _segment(F.col("f_len.after"), b, F.lit(edits + 1) - i)
    key = F.xxhash64("key", a, b, F.col("f_len.before"), F.col("f_len.after"), F.substring("line", pa + oa, la),
                     F.substring("line", start + shift + size + pb - 1 + ob, lb))
    return rows.withColumn("finer", key).withColumn("entry", (down == 0) & (shift == 0) & (oa == 0) & (ob == 0)).withColumn("down", down).drop("f", "f_at", "f_len")


def _pair_parity(line: Column) -> Column:
    """Three times 64 bits: the parities of the pairs of neighbouring characters that hash to a bit (``low`` and
    ``high``, by two hashes) and of the characters (``ones``). An edit takes away two pairs at most and brings in
    two, so it turns over four bits of either at most, and two of the last."""
    one = F.lit(1).cast("bigint")
    flip = lambda s, hashed: s.bitwiseXOR(F.call_function("shiftleft", one, F.pmod(hashed, F.lit(64)).cast("int")))
    zero = F.lit(0).cast("bigint")
    bits = lambda x, hash_of: F.aggregate(F.sequence(F.lit(1), F.size(x) - 1), zero, lambda s, j: flip(s, hash_of(F.get(x, j - 1), F.get(x, j))))
    none = F.struct(*[zero.alias(k) for k in ("low", "high", "ones")])
    return F.when(F.char_length(line) < 2, none).otherwise(let(F.split(line, ""), lambda x: F.struct(
        bits(x, F.xxhash64).alias("low"), bits(x, F.hash).alias("high"), F.aggregate(x, zero, lambda s, c: flip(s, F.xxhash64(c))).alias("ones"))))


def _close(parity: Column, other: Column, edits: int) -> Column:
    turned = lambda k: F.bit_count(parity[k].bitwiseXOR(other[k]))
    return (turned("ones") <= 2 * edits) & (turned("low") <= 4 * edits) & (turned("high") <= 4 * edits)


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """``(a, b)``: the pairs within ``edits`` edits, ids as strings."""
    left, right = (texts.select(F.col("t_h").alias(x), F.col("line").alias(f"{x}_line")) for x in ("a", "b"))
    near = pairs.join(left, "a").join(right, "b").where(within(F.col("a_line"), F.col("b_line"), edits))
    return near.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))


def line_places(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, no, h, g)``: every line with a word as two hashes, written once; what follows
    reads this instead of the texts."""
    return materialise(_lines(docs).select("doc_id", "th", "no", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")), "line-places")


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(line, n, h)``: the different lines of ``min_chars`` characters or more, written once for all tiers."""
    # The count is not needed; it keeps the aggregate one by hash with partial sums before the shuffle.
    lines = _lines(docs, min_chars).groupBy("line").agg(F.count(F.lit(1)).alias("times")).where("times > 0")
    return materialise(lines.select("line", F.char_length("line").alias("n"), F.xxhash64("line").alias("h")), "line-long")


def line_links(docs: DataFrame, tiers=((MAX_EDITS, MIN_CHARS, None),)) -> DataFrame:
    """``(h, root)``: the hashes of lines that are linked with another, by component."""
    lines = long_lines(docs, min(min_chars for _, min_chars, _ in tiers))
    links = [_tier_links(lines, *tier) for tier in tiers]
    release(lines)
    return component_roots(reduce(DataFrame.unionByName, links), a="a", b="b").select(F.col("id").cast("bigint").alias("c_h"), "root")


def _tier_links(lines: DataFrame, edits: int, min_chars: int, below: int | None) -> DataFrame:
    """``(a, b)``: links of the lines within ``edits`` edits whose shorter one has ``min_chars``
    characters or more, and fewer than ``below``."""
    held = lines.where(F.col("n") >= min_chars)
    if below is not None:  # the longer one of a pair can exceed it by the edits
        held = held.where(F.col("n") < below + edits)
    lines = held.select(F.encode("line", "UTF-32").alias("wide"), "n", "h")
    index = lines.select("h", F.explode(entries(F.col("wide"), F.col("n"), edits)).alias("i_key"))
    index = index.groupBy("i_key").agg(F.min("h").alias("least"), F.max("h").alias("most"))
    rows = probes(lines, edits, min_chars)
    # A row per key: the index is the side that a hash join holds, and the probes need no sort.
    hits = rows.join(index.hint("shuffle_hash"), F.col("key") == F.col("i_key")).where((F.col("h") != F.col("least")) | (F.col("least") != F.col("most")))
    hits = materialise(hits.select("key", "h", "code", "least", (F.col("least") != F.col("most")).alias("more")), "line-hits")

    met = hits.where("h != least").select(F.least("h", "least").alias("a"), F.greatest("h", "least").alias("b")).distinct()
    needed = materialise(hits.select("h").union(hits.select("least")).distinct().withColumnRenamed("h", "n_h"), "line-needed")
    texts = materialise(held.join(_few(needed, BROADCAST_ROWS), F.col("h") == F.col("n_h")).select(F.col("h").alias("t_h"), "line"), "line-texts", last_use_of=(needed,))
    links = materialise(_verified(met, texts, edits), "line-links")

    more = hits.where("more")
    label = component_roots(links, a="a", b="b").select(F.col("id").cast("bigint").alias("l_h"), F.col("root").cast("bigint").alias("label"))
    more = more.join(label, F.col("h") == F.col("l_h"), "left").withColumn("label", F.coalesce("label", "h"))
    apart = texts.join(more.select("h").distinct(), F.col("t_h") == F.col("h"), "left_semi").withColumn("parity", _pair_parity(F.col("line")))
    more = more.join(apart, F.col("h") == F.col("t_h")).withColumn("n", F.char_length("line"))
    finer = _finer(more, edits).select("h", "down", "label", "parity", F.struct("finer", "entry", (F.col("h") == F.col("least")).alias("first")).alias("k"))
    finer = materialise(finer.groupBy("h", "down", "label", "parity").agg(F.collect_set("k").alias("keys")), "line-finer", last_use_of=(hits,))
    apart = _apart(finer, edits).distinct()
    return materialise(links.unionByName(_verified(apart, texts, edits)), "line-tier", last_use_of=(links, finer, texts))


def _apart(finer: DataFrame, edits: int) -> DataFrame:
    """``(a, b)``: the lines of different labels that share a finer key and may be within the edits. They meet
    under the least of the keys they share, not under each. The least line of a segment has met all others
    already; of two lines that both stand under a key, one seeks the other."""
    held = finer.where("down = 0").select(F.col("h").alias("o_h"), F.col("label").alias("o_label"), F.col("parity").alias("o_parity"),
                                          F.filter("keys", lambda k: k["entry"]).alias("keys"))
    held = held.select("o_h", "o_label", "o_parity", F.transform("keys", lambda k: k["finer"]).alias("own"), F.explode("keys").alias("k")).where("NOT k.first")
    held = held.select(F.col("k.finer").alias("o_key"), "o_h", "o_label", "o_parity", "own")
    sought = finer.select("h", "label", "parity", F.transform("keys", lambda k: k["finer"]).alias("asked"), F.explode("keys").alias("k")).where("NOT (k.entry AND k.first)")
    sought = sought.select(F.col("k.finer").alias("s_key"), F.col("k.entry").alias("entry"), "h", "label", "parity", "asked")
    return (sought.join(held, (F.col("s_key") == F.col("o_key")) & (F.col("label") != F.col("o_label")) & (~F.col("entry") | (F.col("h") < F.col("o_h")))
                        & _close(F.col("parity"), F.col("o_parity"), edits) & (F.array_min(F.array_intersect("asked", "own")) == F.col("s_key")))
                  .select(F.least("h", "o_h").alias("a"), F.greatest("h", "o_h").alias("b")))


def removals(docs: DataFrame, edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, tiers=None) -> DataFrame:
    """``(r_id, r_th, removed)``: per text the numbers (from 0) of the lines to remove, ascending."""
    written = line_places(docs)
    linked = materialise(line_links(docs, tiers or ((edits, min_chars, None),)), "line-components")
    places = written.join(_few(linked, BROADCAST_ROWS), F.col("h") == F.col("c_h"), "left")
    places = places.select("doc_id", "th", "no", F.coalesce(F.xxhash64("root"), "h").alias("h"), F.when(F.col("root").isNull(), F.col("g")).otherwise(0).alias("g"))
    firsts = (places.groupBy("h", "g").agg(F.min(F.struct("doc_id", "no")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
                    .select(F.col("h").alias("f_h"), F.col("g").alias("f_g"), "first"))
    later = (places.join(firsts, (F.col("h") == F.col("f_h")) & (F.col("g") == F.col("f_g")))
                   .where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("no") == F.col("first.no")))))
    gone = later.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("no")).alias("removed"))
    return materialise(gone.select(F.col("doc_id").alias("__r_id"), F.col("th").alias("__r_th"), F.col("removed").alias("__removed")),
                       "line-removals", last_use_of=(written, linked))


def dedup_lines(docs: DataFrame, edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, tiers=None) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``, and ``__n_lines``, ``__n_removed``;
    ``tiers`` stand in the place of ``edits`` and ``min_chars`` where given."""
    gone = removals(docs, edits, min_chars, tiers)
    text = F.col("text").cast("string")
    rows = docs.join(_few(gone, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("__r_id")) & (F.xxhash64(text) == F.col("__r_th")), "left")
    rest = let(F.split(text, "\n", -1), lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__removed")), lambda i: F.get(x, i)), "\n"))
    return (rows.withColumns({"text": F.when(F.col("__removed").isNull(), text).otherwise(rest),
                              "__n_lines": F.when(text.isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1),
                              "__n_removed": F.coalesce(F.array_size("__removed"), F.lit(0))})
                .select(*docs.columns, "__n_lines", "__n_removed"))
