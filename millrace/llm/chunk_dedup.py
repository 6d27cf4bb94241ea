"""Repeated passages by content-defined places of a gear rolling hash.

``whole_passages`` finds the repeated passages of ``MIN_BYTES`` or more, to the byte. An anchor is
a block of ``BLOCK`` bytes that starts where a gear hash of the block's last 32 bytes is the least
of ``BLOCK`` places in a row; so every 2 * BLOCK - 1 equal bytes hold an anchor at the same place,
wherever they stand, and neighbouring anchors touch. Blocks are compared by 128-bit digests. The
first place of a block, by (doc_id, place), is kept; every later one is a repeat. Repeats that
overlap or touch in a document form a run, also a single one. Each block within ``BLOCK`` bytes of an
end of the run is extended by the longest context that any earlier place of it shares, byte for byte,
and the run reaches as far as the farthest. That is at most ``BLOCK`` bytes beyond a block, or the next
anchor would be a repeat of the same place. The longest is found by halving: in each
round the contexts of a block, cut to the length in question, are grouped and the earliest place of
the group is compared with the run's; equal contexts are one row from the start. The minimum applies to
the extended run, cut to whole characters; runs that then overlap are one row. The two ends of a run,
like its blocks, may repeat different places.

``repeated_passages`` is the coarser form: whole equal chunks alone, without the ends. A text's
bytes are cut where five bits of a gear hash are zero; those bits depend on the last
21 bytes only, so the cuts of a passage are the same wherever it stands, and an insertion moves
no cut but those near it. Cuts closer than ``MIN_CHUNK`` bytes to the one before are passed over,
gaps above ``MAX_CHUNK`` are cut at that length; cuts stand between characters. Neighbouring
repeats in a document form a span, and spans of ``MIN_BYTES`` or more are given; shorter ones
(a common line, a phrase) stay.

Counting is pre-aggregated in the map tasks, so a chunk that a third of all documents share is a
row per task there; the join that brings the counts back to the places is split by AQE where a
chunk is that frequent. Spans are formed in one pass over the places in order, in bounded memory.

Rows: none for a document without repeats, and none for null or empty texts. Rows of one doc_id
with equal texts are one document and repeat nothing of each other; rows of one doc_id with
different texts are told apart by a hash of the text (``whole_passages`` also gives what one of
them repeats of another). A null doc_id counts as the smallest.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise, release, text_slices
from millrace.llm.shingle_sets import text_bytes

GEAR = np.random.default_rng(31_337).integers(0, 1 << 32, 256, dtype=np.uint32)
CUT_MASK = np.uint32(0x1F << 16)
MIN_CHUNK, MAX_CHUNK = 8, 256
MIN_BYTES = 128
#: Bytes of an anchor, and places of which its hash is the least; 2 * BLOCK - 1 must not exceed MIN_BYTES.
BLOCK = 64
#: Bytes of text whose places are looked through at once: the arrays stay in a core's cache.
SLICE = 1 << 17
SPAN = "doc_id bigint, text_hash int, start_byte int, n_bytes int, n_chunks int, first_doc_id bigint"


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, over the last 32 bytes, by doubling the window."""
    h = GEAR[data]
    for k in range(5):
        s = 1 << k
        if len(h) <= s:
            break
        nxt = h.copy()
        nxt[s:] += h[:-s] << np.uint32(s)
        h = nxt
    return h


def cuts(data: np.ndarray) -> list[int]:
    """The ends of the chunks of one text, its length the last; none for an empty text."""
    n = len(data)
    if not n:
        return []
    inner = (data & 0xC0) == 0x80  # a byte that goes on with a character
    found = np.flatnonzero((gear_hash(data[:-1]) & CUT_MASK) == 0) + 1
    found = found[~inner[found]]
    if len(found) and np.any(np.diff(found, prepend=0) < MIN_CHUNK):
        kept, last = [], 0
        for c in found.tolist():
            if c - last >= MIN_CHUNK:
                kept.append(c)
                last = c
    else:
        kept = found.tolist()
    kept.append(n)
    if np.any(np.diff(kept, prepend=0) > MAX_CHUNK):
        out, last = [], 0
        for c in kept:
            while c - last > MAX_CHUNK:
                last += MAX_CHUNK
                while inner[last]:
                    last -= 1
                out.append(last)
            out.append(c)
            last = c
        return out
    return kept


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(d1, d2, doc_id, at)``: the digest's halves; ``at`` = start << 32 | text hash (22 bits) << 9 | length - 1."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                data, offsets = text_bytes(part.column(1))
                raw, digests, at, sizes = data.tobytes(), [], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    ends = cuts(data[a:b])
                    sizes.append(len(ends))
                    if not ends:
                        continue
                    starts = [0, *ends[:-1]]
                    digests += [xxhash.xxh3_128_digest(raw[a + s:a + e]) for s, e in zip(starts, ends)]
                    mark = (xxhash.xxh3_64_intdigest(raw[a:b]) & 0x3FFFFF) << 9
                    s = np.array(starts, np.int64)
                    at.append((s << 32) | (np.array(ends, np.int64) - s - 1) | mark)
                if digests:
                    halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                    owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])),
                                                      part.column(0).take(owner), pa.array(np.concatenate(at))], names=["d1", "d2", "doc_id", "at"])

    return rows.mapInArrow(run, "d1 bigint, d2 bigint, doc_id bigint, at bigint")


def spans(places: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``SPAN`` rows: the repeated passages. ``first_doc_id`` is the document of the first place of the span's longest chunk."""
    times = places.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("times"), F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("no_id"))
    times = times.where("times > 1").select(F.col("d1").alias("t1"), F.col("d2").alias("t2"), F.when(~F.col("no_id"), F.col("least")).alias("first_doc_id"))
    found = (places.join(times, (F.col("d1") == F.col("t1")) & (F.col("d2") == F.col("t2")))
                   .select("doc_id", (F.shiftright("at", 9).bitwiseAND(0x3FFFFF)).cast("int").alias("text_hash"), F.shiftright("at", 32).cast("int").alias("start"),
                           (F.col("at").bitwiseAND(0x1FF) + 1).cast("int").alias("size"), "d1", "first_doc_id"))
    found = found.repartition("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "start")

    def run(batches):
        now = None        # (doc, text) being read
        seen, span = set(), None

        def closed(span):
            if span is not None and span[1] - span[0] >= min_bytes:
                out.append((now[0], now[1], span[0], span[1] - span[0], span[2], span[3]))

        for batch in batches:
            out = []
            for doc, text, start, size, d1, first in zip(*(c.to_pylist() for c in batch.columns)):
                if (doc, text) != now:
                    closed(span)
                    now, seen, span, last = (doc, text), set(), None, -1
                if start == last:
                    continue  # an equal row of the same document
                last = start
                if first == doc:  # its first document: later places in it are repeats
                    repeat = d1 in seen
                    seen.add(d1)
                else:
                    repeat = True
                if not repeat:
                    continue
                if span is not None and span[1] == start:
                    span[1], span[2] = start + size, span[2] + 1
                    if size > span[4]:
                        span[3], span[4] = first, size
                else:
                    closed(span)
                    span = [start, start + size, 1, first, size]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), KINDS)], names=NAMES)
        out = []
        closed(span)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), KINDS)], names=NAMES)

    return found.mapInArrow(run, SPAN)


NAMES = [f.split()[0] for f in SPAN.split(", ")]
KINDS = [pa.int64(), *[pa.int32()] * 4, pa.int64()]


def repeated_passages(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """One row per repeated passage: where it stands, and the document that has it first."""
    return spans(chunks(docs), min_bytes)


def anchors(data: np.ndarray) -> np.ndarray:
    """The starts of the anchors of one text: the first least hash of each ``BLOCK`` places in a row."""
    if len(data) < 2 * BLOCK - 1:
        return np.zeros(0, np.int64)
    order = (gear_hash(data)[BLOCK - 1:] * np.uint32(0x9E3779B1)).astype(np.uint64) << np.uint64(32)
    least, s = order | np.arange(len(order), dtype=np.uint64), 1
    while s < BLOCK:
        least = np.minimum(least[:-s], least[s:])
        s *= 2
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at[np.r_[True, at[1:] != at[:-1]]]


def anchors_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The starts in ``data`` of the anchors of all texts, those of ``anchors`` for each: a hash that counts
    lies within its text, and of the places in a row only those within one text are taken."""
    windows = np.diff(offsets) - (2 * BLOCK - 2)
    if not (windows > 0).any():
        return np.zeros(0, np.int64)
    order = (gear_hash(data)[BLOCK - 1:] * np.uint32(0x9E3779B1)).astype(np.uint64) << np.uint64(32)
    least, s = order | np.arange(len(order), dtype=np.uint64), 1
    while s < BLOCK:
        least = np.minimum(least[:-s], least[s:])
        s *= 2
    edges = np.zeros(len(least) + 1, np.int8)
    first, count = offsets[:-1][windows > 0], windows[windows > 0]
    edges[first] += 1
    edges[first + count] -= 1
    at = (least[np.cumsum(edges[:-1], dtype=np.int8).view(bool)] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at[np.r_[True, at[1:] != at[:-1]]]


def block_digests(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The halves of the 128-bit digest (MurmurHash3, x64) of the ``BLOCK`` bytes from each place on, all places at once."""
    u = np.uint64
    turn = lambda x, k: (x << u(k)) | (x >> u(64 - k))
    c1, c2 = u(0x87C37B91114253D5), u(0x4CF5AD432745937F)
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))    # the eight bytes from each place on
    h1, h2 = np.zeros(len(at), u), np.zeros(len(at), u)
    for k in range(0, BLOCK, 16):
        h1 ^= turn(words[at + k] * c1, 31) * c2
        h1 = (turn(h1, 27) + h2) * u(5) + u(0x52DCE729)
        h2 ^= turn(words[at + k + 8] * c2, 33) * c1
        h2 = (turn(h2, 31) + h1) * u(5) + u(0x38495AB5)
    h1 ^= u(BLOCK)
    h2 ^= u(BLOCK)
    h1 += h2
    h2 += h1
    for h in (h1, h2):
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h ^= h >> u(33)
            h *= u(c)
        h ^= h >> u(33)
    h1 += h2
    h2 += h1
    return h1.view(np.int64), h2.view(np.int64)


def blocks(docs: DataFrame, half: bool = False) -> DataFrame:
    """``(d1, d2, doc_id, at)``: the digest's halves of every anchor; ``at`` = start << 32 | text hash (32 bits).
    With ``half`` ``(d1)`` alone.

    Of equal blocks that overlap one another (a run of one character), one in ``BLOCK`` bytes is given."""
    text = F.col("text").cast("string")
    rows = docs.select(text.alias("text")) if half else docs.select(text.alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"), _text_hash(text).alias("mark"))

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                data, offsets = text_bytes(part.column(0))
                at = anchors_of(data, offsets)
                if not len(at):
                    continue
                d1, d2 = block_digests(data, at)
                owner = np.searchsorted(offsets, at, side="right") - 1
                again = np.r_[False, (d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1]) & (owner[1:] == owner[:-1])]
                if again.any():
                    kept, last = ~again, 0
                    for i in np.flatnonzero(again).tolist():
                        if not again[i - 1]:
                            last = at[i - 1]
                        if at[i] - last >= BLOCK:
                            kept[i], last = True, at[i]
                    at, d1, d2, owner = at[kept], d1[kept], d2[kept], owner[kept]
                if half:
                    yield pa.RecordBatch.from_arrays([pa.array(d1)], names=["d1"])
                    continue
                marks = part.column(2).fill_null(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), part.column(1).take(pa.array(owner)),
                                                  pa.array((at - offsets[owner]) << 32 | marks[owner])], names=["d1", "d2", "doc_id", "at"])

    return rows.mapInArrow(run, "d1 bigint" if half else "d1 bigint, d2 bigint, doc_id bigint, at bigint")


def _text_hash(text):
    return F.xxhash64(text).bitwiseAND(0xFFFFFFFF)


RUN = "doc_id bigint, mark bigint, low int, high int, n int, first_doc_id bigint, heads array<bigint>, tails array<bigint>"


def _runs(repeats: DataFrame) -> DataFrame:
    """``RUN`` rows: the repeats of a text that overlap or touch, bytes ``low`` to ``high``; ``heads`` and
    ``tails`` hold (start, digest) of the blocks less than ``BLOCK`` bytes from its first and its last;
    ``first_doc_id`` holds the longest part in one piece."""
    rows = repeats.select("doc_id", F.col("at").bitwiseAND(0xFFFFFFFF).alias("mark"), F.shiftright("at", 32).cast("int").alias("start"), "f_id", "f_at", "d1", "d2")
    rows = rows.repartition("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "start")
    names, kinds = [f.split()[0] for f in RUN.split(", ")], [pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.int64(), *[pa.list_(pa.int64())] * 2]

    def run(batches):
        now = None  # [doc, text, low, last start, anchors, heads, tails, piece, its start, longest (bytes, doc)]

        def closed():
            if now is not None:
                out.append((now[0], now[1], now[2], now[3] + BLOCK, now[4], now[9][1], now[5], [x for k in now[6] for x in k]))

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            out = []
            for doc, text, start, f_id, f_at, d1, d2 in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != doc or now[1] != text or start - now[3] > BLOCK:
                    closed()
                    now = [doc, text, start, start, 0, [], [], None, start, (0, None)]
                elif start == now[3]:
                    continue  # an equal row of the same document
                piece = (f_id, f_at & 0xFFFFFFFF, start - (f_at >> 32))
                if piece != now[7]:
                    now[7], now[8] = piece, start
                now[3], now[4] = start, now[4] + 1
                if start - now[2] < BLOCK:
                    now[5] += (start, d1, d2)
                now[6] = [k for k in now[6] if start - k[0] < BLOCK] + [(start, d1, d2)]
                if start + BLOCK - now[8] > now[9][0]:
                    now[9] = (start + BLOCK - now[8], f_id)
            if out:
                yield flush()
        out = []
        closed()
        if out:
            yield flush()

    return rows.mapInArrow(run, RUN)


def _reach(own: pa.Array, same: pa.Array, after: pa.Array) -> pa.Array:
    """By how many bytes an end moves out: the bytes of context that agree, less what is not a whole
    character (so it can be negative). A context holds 4 bytes of the block itself."""
    out = []
    for a, n, on in zip(own.to_pylist(), same.to_pylist(), after.to_pylist()):
        n += 4
        if on:
            while n < len(a) and a[n] & 0xC0 == 0x80:
                n -= 1
        else:
            while a[len(a) - n] & 0xC0 == 0x80:
                n -= 1
        out.append(n - 4)
    return pa.array(out, pa.int32())


def _contexts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``(doc_id, at, after, bytes)`` of the places ``asked``: 4 bytes of the block and up to ``BLOCK`` (one more after it) beyond."""
    asked = asked.groupBy("doc_id", F.col("at").bitwiseAND(0xFFFFFFFF).alias("mark")).agg(F.collect_set(F.struct("at", "after")).alias("asked"))
    asked = asked.select(F.col("doc_id").alias("c_id"), F.col("mark").alias("c_mark"), "asked")  # bounded by the text's length
    text = F.col("text").cast("string")
    held = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.cast("binary").alias("raw"), _text_hash(text).alias("mark"))
    held = held.join(asked, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("mark") == F.col("c_mark")))

    def around(x):
        at = F.shiftright(x["at"], 32).cast("int") + F.when(x["after"], BLOCK).otherwise(0)
        low = F.greatest(F.lit(0), at - F.when(x["after"], 4).otherwise(BLOCK))
        return F.struct(x["at"].alias("at"), x["after"].alias("after"),
                        F.substring(F.col("raw"), low + 1, at + F.when(x["after"], BLOCK + 1).otherwise(4) - low).alias("bytes"))
    return held.select(F.col("c_id").alias("doc_id"), F.explode(F.transform("asked", around)).alias("c")).select("doc_id", "c.*")


def _longest_context(docs: DataFrame, places: DataFrame, ends: DataFrame) -> DataFrame:
    """``ends`` (doc_id, at, d1, d2, after, ..) with ``bytes`` around each and ``same``, the bytes of context
    that the longest of all earlier places of the block shares. ``places`` is a written table, used up."""
    block = ["d1", "d2", "after"]
    sides = ends.select(F.col("d1").alias("s1"), F.col("d2").alias("s2"), "after").distinct()
    asked = places.join(sides, (F.col("d1") == F.col("s1")) & (F.col("d2") == F.col("s2")))
    asked = materialise(asked.select("d1", "d2", "after", "doc_id", "at").distinct(), "passage-asked", last_use_of=(places,))
    around = _contexts(docs, asked).dropDuplicates(["doc_id", "at", "after"])     # rows of one document more than once
    around = around.select(F.col("doc_id").alias("c_id"), F.col("at").alias("c_at"), F.col("after").alias("c_after"), "bytes")
    here = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("at") == F.col("c_at")) & (F.col("after") == F.col("c_after"))
    held = materialise(asked.join(around, here).select(*block, "doc_id", "at", "bytes"), "passage-contexts", last_use_of=(asked,))
    beyond = F.when(F.col("after"), F.substring("bytes", 5, BLOCK)).otherwise(F.substring("bytes", F.lit(1), F.length("bytes") - 4))
    place = F.struct("doc_id", "at")
    index = materialise(held.groupBy(*block, beyond.alias("context")).agg(F.min(place).alias("place")), "passage-index")

    def cut(n):
        context = F.col("context")
        return F.when(F.col("after"), F.substring(context, F.lit(1), n)).otherwise(F.substring(context, F.length(context) - n + 1, n))

    # Only places, contexts and the two bounds go through the rounds.
    key = [*block, "doc_id", "at"]
    named = lambda df, cs: df.select(*[F.col(c).alias(f"m_{c}") for c in cs])
    mine = F.col("doc_id").eqNullSafe(F.col("m_doc_id")) & (F.col("at") == F.col("m_at")) & (F.col("after") == F.col("m_after"))
    open_ = held.join(named(ends, ["doc_id", "at", "after"]), mine, "left_semi").select(*key, beyond.alias("context"))
    open_ = materialise(open_.withColumn("same", F.lit(0)).withColumn("most", F.length("context")), "passage-ends")
    for _ in range(BLOCK.bit_length()):
        trial = open_.withColumn("try", F.ceil((F.col("same") + F.col("most")) / 2).cast("int"))
        lengths = trial.where("most > same").select(*block, "try").distinct()
        tried = index.join(lengths, block).where(F.length("context") >= F.col("try"))
        first = tried.groupBy(*block, "try", cut(F.col("try")).alias("part")).agg(F.min("place").alias("earliest"))
        first = first.select(*[F.col(c).alias(f"f_{c}") for c in (*block, "try", "part")], "earliest")
        match = F.col("most") > F.col("same")
        for c in (*block, "try"):
            match = match & (F.col(c) == F.col(f"f_{c}"))
        found = trial.join(first, match & (cut(F.col("try")) == F.col("f_part")), "left")
        going, longer = F.col("most") > F.col("same"), F.coalesce(F.col("earliest") < place, F.lit(False))
        open_ = materialise(found.select(*key, "context", F.when(going & longer, F.col("try")).otherwise(F.col("same")).alias("same"),
                                         F.when(going & ~longer, F.col("try") - 1).otherwise(F.col("most")).alias("most")), "passage-ends", last_use_of=(open_,))
    release(index)
    done = open_.join(named(held, ["doc_id", "at", "after", "bytes"]), mine).select(*[F.col(c).alias(f"d_{c}") for c in ("doc_id", "at", "after")], "same", F.col("m_bytes").alias("bytes"))
    return ends.join(done, F.col("doc_id").eqNullSafe(F.col("d_doc_id")) & (F.col("at") == F.col("d_at")) & (F.col("after") == F.col("d_after")))


def _merged(found: DataFrame) -> DataFrame:
    """``SPAN`` rows of ``(doc_id, mark, low, high, n, first_doc_id)``, overlapping ones as one."""
    rows = found.repartition("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "low", "high")

    def run(batches):
        now = None  # [doc, text, low, high, anchors, first, longest]

        def closed():
            if now is not None:
                out.append((now[0], now[1] & 0x3FFFFF, now[2], now[3] - now[2], now[4], now[5]))

        for batch in batches:
            out = []
            for doc, text, low, high, n, first in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != doc or now[1] != text or low >= now[3]:
                    closed()
                    now = [doc, text, low, high, n, first, high - low]
                    continue
                if high - low > now[6]:
                    now[5], now[6] = first, high - low
                now[3], now[4] = max(now[3], high), now[4] + n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), KINDS)], names=NAMES)
        out = []
        closed()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), KINDS)], names=NAMES)

    return rows.mapInArrow(run, SPAN)


def whole_passages(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``SPAN`` rows: the repeated passages of ``min_bytes`` (2 * BLOCK - 1 at least) or more, to the byte; ``n_chunks`` counts their anchors."""
    if min_bytes < 2 * BLOCK - 1:
        raise ValueError(f"min_bytes below {2 * BLOCK - 1}: shorter passages need not hold an anchor")
    # Half a digest is enough here: what stands once under the whole one is its own first place below.
    times = blocks(docs, half=True).groupBy(F.col("d1").alias("t1")).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("t1")
    places = materialise(blocks(docs).join(times, F.col("d1") == F.col("t1")).select("d1", "d2", "doc_id", "at"), "passage-places")
    firsts = places.groupBy(F.col("d1").alias("t1"), F.col("d2").alias("t2")).agg(F.min(F.struct("doc_id", "at")).alias("f"))
    repeats = (places.join(firsts, (F.col("d1") == F.col("t1")) & (F.col("d2") == F.col("t2")))
                     .where(~(F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("at") == F.col("f.at"))))
                     .select("doc_id", "at", F.col("f.doc_id").alias("f_id"), F.col("f.at").alias("f_at"), "d1", "d2"))
    runs = materialise(_runs(repeats), "passage-runs")
    same = ["doc_id", "mark", "low", "high", "n", "first_doc_id"]

    def side(ends, after):
        block = F.transform(F.sequence(F.lit(0), (F.size(ends) / 3 - 1).cast("int")), lambda i: F.struct(*[F.element_at(ends, i * 3 + k).alias(c) for k, c in enumerate(("start", "d1", "d2"), 1)]))
        exploded = runs.select(*same, F.explode(block).alias("b"))
        return exploded.select(*same, F.shiftleft("b.start", 32).bitwiseOR(F.col("mark")).alias("at"), "b.d1", "b.d2", F.lit(after).alias("after"))

    ends = side(F.col("heads"), False).unionByName(side(F.col("tails"), True))
    ends = _longest_context(docs, places, ends).withColumnRenamed("same", "agree")
    reach, start = F.arrow_udf(_reach, "int")("bytes", "agree", "after"), F.shiftright("at", 32).cast("int")
    ends = ends.withColumn("reach", reach).withColumn("edge", F.when(F.col("after"), start + BLOCK + F.col("reach")).otherwise(start - F.col("reach")))
    found = ends.groupBy(*same).agg(F.min(F.when(~F.col("after"), F.col("edge"))).alias("from"), F.max(F.when(F.col("after"), F.col("edge"))).alias("to"))
    found = found.select("doc_id", "mark", F.col("from").alias("low"), F.col("to").alias("high"), "n", "first_doc_id")
    return _merged(found.where(F.col("high") - F.col("low") >= min_bytes))


def without_passages(docs: DataFrame, found: DataFrame, broadcast_rows: int = 300_000) -> DataFrame:
    """``docs`` with the spans ``found`` cut out of the texts; other columns as they are. Rows of one
    doc_id with different texts must not occur here; a document without spans stays as it is."""
    cut = (found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_byte", "n_bytes"))).alias("__cut"))
                .withColumnRenamed("doc_id", "__cut_id"))
    if cut.count() <= broadcast_rows:
        cut = F.broadcast(cut)
    names = docs.columns

    @F.arrow_udf("string")
    def rest(text: pa.Array, cut: pa.Array) -> pa.Array:
        out = []
        for t, spans_ in zip(text.to_pylist(), cut.to_pylist()):
            if spans_:
                raw, kept, at = t.encode(), [], 0
                for s in spans_:
                    kept.append(raw[at:s["start_byte"]])
                    at = s["start_byte"] + s["n_bytes"]
                t = b"".join([*kept, raw[at:]]).decode()
            out.append(t)
        return pa.array(out, pa.string())

    return docs.join(cut, F.col("doc_id").eqNullSafe(F.col("__cut_id")), "left").withColumn("text", rest("text", "__cut")).select(*names)
