"""Phrase collocations by SETM: relations of occurrences, merge-joined and grouped length by length.

1. Texts are cut into pieces and words once. The relation R1 of (piece, position, word) is written in
   blocks, each a run of documents of one language, in order of place: one number a place, which grows
   by one within a piece and by more from piece to piece. No phrase spans two documents, so blocks are
   independent.
2. Groups (words, later phrases) are counted per block, summed (pairs are pre-aggregated per task and
   sent sorted and packed, a row per task and bucket), and those of ``least`` occurrences or more get an id. A semi-join leaves their occurrences in R1.
3. R(k+1) is the merge-join of Rk with itself on piece and next position: a phrase of k + 1 words
   stands where its first k words stand and its last k stand one place on. Its group is the pair of
   their ids, so nothing is hashed and counts are exact. Count, semi-join, repeat to ``longest`` words.
   Frequent groups go to the blocks by broadcast up to ``BROADCAST_GROUPS`` (and ``BROADCAST_BYTES`` of
   words), beyond that by joins on (block, group), pre-aggregated per block.
4. Counts of a phrase's beginnings and ends come along with its ids, so each cut's score is one exact
   decimal division.

Frequencies fall with length, so a phrase lies in an equally frequent longer one exactly when it lies in
one of a single word more.

Null texts are empty, null languages ``und``; repeated rows count each time; an empty table gives an
empty one; other columns are not read. Words are compared by their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import n_buckets, shared_folder, text_slices
from millrace.llm.shingle_sets import mix, text_bytes

#: Bytes of text in a block, and groups (bytes of their words) that are broadcast at most.
BLOCK_BYTES = 4 << 20
BROADCAST_GROUPS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: Distinct pairs that a task holds before it sends them, and occurrences of pairs for each bucket they go to.
HELD_PAIRS, BUCKET_PAIRS = 2_000_000, 2_000_000
WORD_BYTE, WHITE_BYTE, PIECE_BYTE = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = WHITE_BYTE
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = PIECE_BYTE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _written(df: DataFrame, what: str) -> DataFrame:
    path = shared_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of all words of the texts in order: text, place, code; and the words by code."""
    data, offsets = text_bytes(column)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.string())
    kind = KIND[data]
    black = kind == WORD_BYTE
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(black & np.r_[True, ~black[:-1] | edge[1:n]])
    ends = np.flatnonzero(black & np.r_[~black[1:] | edge[1:n], True]) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(kind == PIECE_BYTE, dtype=np.int32 if n < 1 << 31 else np.int64)[starts] + text
    at = np.arange(len(starts)) + piece
    joined = LOWER[data[black]]
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.r_[0, np.cumsum(ends - starts)].astype(np.int64)), pa.py_buffer(joined)])
    coded = words.dictionary_encode()
    return text, at, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary.cast(pa.string())


def occurrences(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(block, lang, gaps, codes, words, counts)``, a row per block; places as differences."""
    schema = "block bigint, lang string, gaps binary, codes binary, words array<string>, counts array<bigint>"

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in text_slices(batch, "text", BLOCK_BYTES):
                text, at, code, words = words_of(part.column(1))
                lang = part.column(0).dictionary_encode()
                of = lang.indices.to_numpy(zero_copy_only=False)[text]
                order = np.argsort(of, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0, True]) if len(of) else [0]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    held = order[a:b]
                    used, local = np.unique(code[held], return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number]), pa.array([lang.dictionary[int(of[held[0]])].as_py()], pa.string()),
                         pa.array([_gaps(at[held])], pa.binary()), pa.array([local.astype("<i4").tobytes()], pa.binary()),
                         pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), words.take(pa.array(used))),
                         pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), pa.array(np.bincount(local), pa.int64()))],
                        names=["block", "lang", "gaps", "codes", "words", "counts"])
                    number += 1

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return _written(rows.mapInArrow(run, schema), "occurrences")


def _gaps(at: np.ndarray) -> bytes:
    """Places as differences of one, two or four bytes."""
    gaps = np.diff(at, prepend=0)
    return gaps.astype("<u1" if gaps.max() < 1 << 8 else "<u2" if gaps.max() < 1 << 16 else "<u4").tobytes()


def _places(gaps, n: int) -> np.ndarray:
    """The places of ``n`` occurrences."""
    return np.cumsum(np.frombuffer(gaps, f"<u{len(gaps) // n}"), dtype=np.int64)


def _rows(batch: pa.RecordBatch, *names: str):
    """The values of each row; binary ones as buffers, not copied."""
    columns = [batch.column(n) for n in names]
    for k in range(batch.num_rows):
        yield [c[k].as_buffer() if pa.types.is_binary(c.type) else c[k].as_py() for c in columns]


def _next(gaps, codes, ids):
    """The merge-join of a block's relation with itself at the next position: places, each one's number
    among the block's distinct pairs, the pairs, and how often each stands there."""
    group, ids = np.frombuffer(codes, "<i4"), np.frombuffer(ids, "<i8")
    at = _places(gaps, len(group))
    first = np.flatnonzero(at[1:] - at[:-1] == 1)
    key, pair, counts = np.unique(group[first] * np.int64(len(ids)) + group[first + 1], return_inverse=True, return_counts=True)
    return at[first], pair, ids[key // len(ids)], ids[key % len(ids)], counts


def _block(block: int, at: np.ndarray, number: np.ndarray, ids: np.ndarray):
    """A block of the next relation: the occurrences whose group has an id."""
    held = ids[number] >= 0
    if held.any():
        used, codes = np.unique(ids[number[held]], return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_gaps(at[held])], pa.binary()), pa.array([codes.astype("<i4").tobytes()], pa.binary()),
                                          pa.array([used.astype("<i8").tobytes()], pa.binary())], names=["block", "gaps", "codes", "groups"])


#: A block's occurrences: differences of places, numbers of groups, and the ids of the numbered groups.
RELATION = "block bigint, gaps binary, codes binary, groups binary"


def _pairs(relation: DataFrame) -> DataFrame:
    """``(block, number, first, second)``: the distinct pairs of each block."""

    def run(batches):
        for batch in batches:
            for block, gaps, codes, groups in _rows(batch, "block", "gaps", "codes", "groups"):
                _, _, first, second, n = _next(gaps, codes, groups)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block)), pa.array(np.arange(len(n))), pa.array(first), pa.array(second)],
                                                 names=["block", "number", "first", "second"])

    return relation.mapInArrow(run, "block bigint, number bigint, first bigint, second bigint")


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, compressed: high planes are mostly zero."""
    return pa.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel()


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, n) of several parts, sorted, each pair once."""
    first, second, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    starts = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
    return first[starts], second[starts], np.add.reduceat(n[order], starts)


def _pair_counts(relation: DataFrame, least: int) -> DataFrame:
    """``(first, second, a)`` of the pairs with ``least`` occurrences or more."""
    places = relation.agg(F.sum(F.length("codes") / 4)).first()[0] or 0
    buckets = max(n_buckets(relation), int(places) // BUCKET_PAIRS + 1)

    def run(batches):
        held, size = [], 0

        def sent():
            first, second, n = _summed(held)
            bucket = (mix(first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
            out = [(int(bucket[k[0]]), len(k), _packed(np.diff(first[k], prepend=0)), _packed(second[k]), _packed(n[k])) for k in (order[a:b] for a, b in zip(cuts[:-1], cuts[1:]))]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["bucket", "size", "first", "second", "n"])

        for batch in batches:
            for gaps, codes, groups in _rows(batch, "gaps", "codes", "groups"):
                _, _, first, second, n = _next(gaps, codes, groups)
                if len(n):
                    held.append((first, second, n))
                    size += len(n)
                if size > HELD_PAIRS:
                    yield sent()
                    size = 0
        if held:
            yield sent()

    def merged(table: pa.Table) -> pa.Table:
        parts = [(np.cumsum(_unpacked(a, size)), _unpacked(b, size), _unpacked(n, size)) for size, a, b, n in zip(*(table.column(c).to_pylist() for c in ("size", "first", "second", "n")))]
        first, second, n = _summed(parts)
        often = n >= least
        return pa.table({"first": first[often], "second": second[often], "a": n[often]})

    sent = relation.mapInArrow(run, "bucket bigint, size bigint, first binary, second binary, n binary")
    return sent.groupBy("bucket").applyInArrow(merged, "first bigint, second bigint, a bigint")


def _numbered(groups: DataFrame) -> DataFrame:
    return _written(groups.withColumn("id", F.monotonically_increasing_id()), "frequent")


def _ids_by_block(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(groups, keys).groupBy("block").agg(F.collect_list("number").alias("numbers"), F.collect_list("id").alias("ids"))


def _scattered(numbers: list, ids: list, n: int) -> np.ndarray:
    out = np.full(n, -1)
    out[np.asarray(numbers, np.int64)] = ids
    return out


def frequent_words(first: DataFrame, least: int, broadcast: int) -> tuple[DataFrame, DataFrame]:
    """Frequent words ``(lang, word, a, id)`` and the relation of their occurrences."""
    counts = first.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    words = _numbered(counts.groupBy("lang", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= least))
    size = words.agg(F.count("*"), F.sum(F.octet_length("word"))).first()
    if size[0] <= broadcast and (size[1] or 0) <= BROADCAST_BYTES:
        by_lang: dict[str, tuple[list, list]] = {}
        for lang, word, i in words.select("lang", "word", "id").toLocalIterator():
            by_lang.setdefault(lang, ([], []))[0].append(word)
            by_lang[lang][1].append(i)
        held = first.sparkSession.sparkContext.broadcast(by_lang)

        def run(batches):
            known = {lang: (pa.array(w, pa.string()), np.array(i)) for lang, (w, i) in held.value.items()}
            for batch in batches:
                for k, (block, lang, gaps, codes) in enumerate(_rows(batch, "block", "lang", "gaps", "codes")):
                    if lang in known:
                        found = pc.index_in(batch.column("words")[k].values, known[lang][0]).fill_null(-1).to_numpy()
                        ids, number = np.where(found >= 0, known[lang][1][found], -1), np.frombuffer(codes, "<i4")
                        yield from _block(block, _places(gaps, len(number)), number, ids)

        return words, _written(first.select("block", "lang", "gaps", "codes", "words").mapInArrow(run, RELATION), "relation")
    rows = first.select("block", "lang", F.posexplode("words").alias("number", "word"))
    ids = _ids_by_block(rows, words.select("lang", "word", "id"), ["lang", "word"])

    def matched(batches):
        for batch in batches:
            for block, gaps, codes, n, numbers, found in _rows(batch, "block", "gaps", "codes", "n", "numbers", "ids"):
                number = np.frombuffer(codes, "<i4")
                yield from _block(block, _places(gaps, len(number)), number, _scattered(numbers, found, n))

    joined = first.select("block", "gaps", "codes", F.size("words").alias("n")).join(ids, "block")
    return words, _written(joined.mapInArrow(matched, RELATION), "relation")


def longer_phrases(relation: DataFrame, least: int, broadcast: int) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of a word more, ``(first, second, a, id)``, and the relation of their occurrences."""
    groups = _numbered(_pair_counts(relation, least))
    if groups.count() <= broadcast:
        rows = groups.select("first", "second", "id").toArrow()
        held = relation.sparkSession.sparkContext.broadcast([rows.column(k).to_numpy() for k in range(3)])

        def run(batches):
            one, two, ids = held.value
            ones, twos = np.unique(one), np.unique(two)
            keys = np.searchsorted(ones, one) * len(twos) + np.searchsorted(twos, two)
            order = np.argsort(keys)
            keys, ids = keys[order], ids[order]
            for batch in batches:
                for block, gaps, codes, groups in _rows(batch, "block", "gaps", "codes", "groups"):
                    at, number, first, second, _ = _next(gaps, codes, groups)
                    if len(keys) and len(first):
                        i, j = np.searchsorted(ones, first).clip(max=len(ones) - 1), np.searchsorted(twos, second).clip(max=len(twos) - 1)
                        sought = i * len(twos) + j
                        k = np.searchsorted(keys, sought).clip(max=len(keys) - 1)
                        known = (ones[i] == first) & (twos[j] == second) & (keys[k] == sought)
                        yield from _block(block, at, number, np.where(known, ids[k], -1))

        return groups, _written(relation.mapInArrow(run, RELATION), "relation")
    ids = _ids_by_block(_pairs(relation), groups.select("first", "second", "id"), ["first", "second"])

    def matched(batches):
        for batch in batches:
            for block, gaps, codes, groups, numbers, found in _rows(batch, "block", "gaps", "codes", "groups", "numbers", "ids"):
                at, number, first, _, _ = _next(gaps, codes, groups)
                yield from _block(block, at, number, _scattered(numbers, found, len(first)))

    return groups, _written(relation.join(ids, "block").mapInArrow(matched, RELATION), "relation")


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, broadcast: int = BROADCAST_GROUPS) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, a, heads, tails, closed)`` of every phrase of 2 to ``longest`` words with ``least``
    or more occurrences (``heads``, ``tails``: counts of its beginnings and ends of 1, 2 ... words;
    ``closed``: in no longer one as frequent), and ``(lang, n)``, the words of each language."""
    first = occurrences(docs)
    totals = _written(first.groupBy("lang").agg(F.sum((F.length("codes") / 4).cast("bigint")).alias("n")), "totals")
    words, relation = frequent_words(first, least, broadcast)
    one = F.array("a")
    known = words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", one.alias("heads"), one.alias("tails"))
    found = []
    for _ in range(2, longest + 1):
        groups, relation = longer_phrases(relation, least, broadcast)
        inner = groups.select(F.explode(F.array("first", "second")).alias("inner"), "a").groupBy("inner").agg(F.max("a").alias("most"))
        found.append(known.join(inner, known["id"] == inner["inner"], "left").withColumn("closed", F.coalesce(F.col("most") < F.col("a"), F.lit(True))))
        head = known.select(F.col("id").alias("first"), "lang", F.col("phrase").alias("start"), F.col("heads").alias("h"))
        tail = known.select(F.col("id").alias("second"), "last", F.col("tails").alias("t"))
        known = _written(groups.join(head, "first").join(tail, "second").select(
            "id", "lang", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "a",
            F.concat("h", F.array("a")).alias("heads"), F.concat("t", F.array("a")).alias("tails")), "phrases")
    found.append(known.withColumn("closed", F.lit(True)))
    columns = ["lang", "phrase", "a", "heads", "tails", "closed"]
    out = found[1].select(columns) if len(found) > 1 else found[0].select(columns).limit(0)
    for x in found[2:]:
        out = out.unionByName(x.select(columns))
    return out, totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2_000, broadcast: int = BROADCAST_GROUPS) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` closed phrases of each language."""
    phrases, totals = frequent_phrases(docs, least, longest, broadcast)
    whole = [F.col(c).cast("decimal(19,0)") for c in ("a", "n")]
    times = F.lit(1000).cast("decimal(4,0)") * (whole[0] * whole[1]).cast("decimal(34,0)")
    lowest = phrases.where("closed").join(totals, "lang").withColumn("times", times).withColumn("x", F.expr("""
        array_min(transform(sequence(1, size(heads) - 1), k -> struct(
            times div (cast(heads[k - 1] AS decimal(19,0)) * cast(tails[size(tails) - k - 1] AS decimal(19,0))) AS score,
            k AS k, heads[k - 1] AS l, tails[size(tails) - k - 1] AS r)))"""))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = lowest.select("lang", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score")).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
