"""Token ids in compressed binary files: a context-mixing range coder over independent blocks.

File: ``MAGIC``, then blocks. A block holds up to ``BLOCK`` ids: its header (counts, CRC-32 of the
ids as little-endian unsigned 32-bit integers, CRC-32 of header and document table), the table of
the documents whose ids it holds, and the coded words. Documents stand in ascending order and may
go on from block to block; every block starts with a fresh model, so each is decoded by itself.

Model: after ids a, b two tables hold the id last seen after (a, b) and after b (orders 2 and 1),
each with a confidence. One symbol a step says whether the next id is the order-2 or the order-1
prediction, or else its class, mostly the octave of id + 1. The symbol's chances are the mean of two adaptive
distributions: by the tables' confidences and whether they agree, and by the class of b.
The bits below the class of an id that was not predicted follow as they are, in the same step.

Coder: a range coder of 64 bits that puts out words of 32, one narrowing an id. All blocks of a
batch are coded side by side, one NumPy lane each, so no Python code runs per id.

Writing: documents are range-partitioned and sorted by (doc_id, text), nulls first; a task writes
its file under a name of its attempt and renames it when complete. Reading: files are read by
Spark; every checksum is checked, and any fault raises.

Rows: one per input row, null text as empty (the end id alone). Repeated rows are separate
documents. An empty table gives no file and an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.byte_bpe import Memo, _gathered, unit_starts
from millrace.llm.common import as_text, bounded_batches, materialise, shared_folder, text_slices, worker_state
from millrace.llm.shingle_sets import text_bytes
from millrace.llm.warc import _filesystem

MAGIC = b"MRIDS\x02\x00\x00"
BLOCK = 2048
LANES = 4096
HEADER = "<IIIII"  # ids, documents, words, CRC-32 of the ids, CRC-32 of header start and document table
DOCUMENT = "<qBI"  # doc_id, flags (1: null id, 2: ends in this block), ids
SLOTS = 1 << 11  # of a prediction table
MEMO = 200_000  # units of a generation that a worker keeps (memory bound, not a limit on results)
MOST = 65_534  # the largest id
U64 = np.uint64
LOW32, LEAST, UNIT = U64(0xFFFFFFFF), U64(0xFFFFFFFF), U64(31)
# Of id + 1, the classes by their first member and its bits below: octaves, finer where most ids of a text are.
CLASSES = ([(0, 3), (8, 2), (12, 1), (14, 1)] + [(1 << k, k) for k in range(4, 8)] + [(x, 6) for x in range(256, 512, 64)]
           + [(1 << k, k) for k in range(9, 16)])
# Symbols of a step: the order-2 prediction, the order-1 prediction, then the classes. A row of chances holds
# their starts in 15 bits, and where a last one that does not occur would start.
SYMBOLS, COLUMNS = len(CLASSES) + 2, len(CLASSES) + 3
# Of either table: no prediction, or one of its confidence; and whether both agree.
STATES = 50
HELD = np.arange(1, 5)
FIRST, BITS = np.array([0, 0] + [x for x, _ in CLASSES]), np.array([0, 0] + [k for _, k in CLASSES])
SYMBOL = np.searchsorted(FIRST[2:], np.arange(MOST + 2), side="right") + 1
EVEN = (np.arange(COLUMNS) * ((1 << 15) // COLUMNS)).astype(np.int16)


def _towards(least: int) -> np.ndarray:
    """By symbol, the starts when all but ``least`` for each other symbol is its own: moving there by
    1 / least, rounded down, leaves every symbol a chance."""
    rest = (1 << 15) - (COLUMNS - 1) * least
    return np.array([[least * c + (rest - least if c > symbol else 0) for c in range(COLUMNS)] for symbol in range(SYMBOLS)]).astype(np.int16)


TOWARDS = _towards(32)


class _Coder:
    """The range [low, high] of each lane, 2**32 numbers or more between steps; subclasses write or read.

    A step narrows it to the part of a symbol, 1 / 2**16 or more, and of the bits that stand below it, 15 at
    most: ``UNIT`` parts in all."""

    def __init__(self, lanes: int):
        self.low, self.high = np.zeros(lanes, U64), np.full(lanes, ~U64(0))

    def _narrow(self, step: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        n = len(step)
        low, high = self.low[:n], self.high[:n]
        low += step * start.astype(U64)
        np.copyto(high, low + (step * size.astype(U64) - U64(1)))
        at = np.flatnonzero(high - low < LEAST)
        if len(at):     # the upper word is settled, or the range is cut to the part below a border of words
            x = low[at]
            y = np.where((x ^ high[at]) <= LOW32, high[at], x | LOW32)
            self._word(at, x >> U64(32))
            low[at] = x << U64(32)
            high[at] = (y << U64(32)) | LOW32


class _Encoder(_Coder):
    def __init__(self, lanes: int, ids: int):
        super().__init__(lanes)
        self.out, self.at = np.zeros((lanes, ids + 2), np.uint32), np.zeros(lanes, np.int64)

    def _word(self, at, word) -> None:
        self.out[at, self.at[at]] = word
        self.at[at] += 1

    def step(self, mixed, row, symbol, rest):
        """Writes each lane's symbol and the bits below it; ``mixed`` holds the starts of the symbols."""
        n = len(symbol)
        flat, at = mixed.ravel(), row + symbol
        start = flat.take(at).astype(np.int64)
        part = (flat.take(at + 1).astype(np.int64) - start) << (15 - BITS.take(symbol))
        self._narrow((self.high[:n] - self.low[:n]) >> UNIT, (start << 15) + rest * part, part)
        return symbol, rest

    def words(self) -> list[bytes]:
        for shift in (32, 0):
            self._word(np.arange(len(self.at)), (self.low >> U64(shift)) & LOW32)
        return [row[:n].astype("<u4").tobytes() for row, n in zip(self.out, self.at.tolist())]


class _Decoder(_Coder):
    def __init__(self, words: list[bytes]):
        super().__init__(len(words))
        counts = [len(w) // 4 for w in words]
        self.src = np.zeros((len(words), max(counts) + 4), np.uint32)
        for k, w in enumerate(words):
            self.src[k, :counts[k]] = np.frombuffer(w, "<u4")
        self.at = np.full(len(words), 2, np.int64)
        self.now = (self.src[:, 0].astype(U64) << U64(32)) | self.src[:, 1]

    def _word(self, at, _) -> None:
        k = np.minimum(self.at[at], self.src.shape[1] - 1)
        self.now[at] = (self.now[at] << U64(32)) | self.src[at, k]
        self.at[at] += 1

    def step(self, mixed, row, *_):
        n = len(row)
        step = (self.high[:n] - self.low[:n]) >> UNIT
        place = np.minimum((self.now[:n] - self.low[:n]) // step, U64((1 << 31) - 1)).astype(np.int64)
        symbol = (mixed[:, 1:SYMBOLS] <= (place >> 15).astype(np.uint16)[:, None]).view(np.uint8).sum(axis=1, dtype=np.uint8).astype(np.int64)
        flat, at = mixed.ravel(), row + symbol
        start = flat.take(at).astype(np.int64)
        bits = BITS.take(symbol)
        part = (flat.take(at + 1).astype(np.int64) - start) << (15 - bits)
        rest = ((place - (start << 15)) / part).astype(np.int64)     # exact: both are below 2**31
        rest = np.minimum(rest, (1 << bits) - 1)
        self._narrow(step, (start << 15) + rest * part, part)
        return symbol, rest


def _run(coder, counts: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
    """Codes the blocks, longest first, or fills the ids from the decoder: a row of ids per place, a column per block."""
    lanes, n = len(counts), int(counts[0])
    out = ids if ids is not None else np.zeros((n, lanes), np.int32)
    state_row, class_row = np.arange(lanes, dtype=np.int64) * STATES, np.arange(lanes, dtype=np.int64) * SYMBOLS
    row, slot = np.arange(lanes, dtype=np.int64) * COLUMNS, np.arange(lanes, dtype=np.int64) * SLOTS
    by_state, by_class = np.tile(EVEN, (lanes * STATES, 1)), np.tile(EVEN, (lanes * SYMBOLS, 1))
    table1, table2 = np.zeros(lanes * SLOTS, np.int32), np.zeros(lanes * SLOTS, np.int32)  # id + 1, times 4, plus confidence
    a = b = np.zeros(lanes, np.int64)
    live = np.searchsorted(-counts, -np.arange(n), side="left").tolist()     # lanes with an id at a place
    for k in range(n):
        m = live[k]
        if m < len(a):
            a, b, row, slot, state_row, class_row = (x[:m] for x in (a, b, row, slot, state_row, class_row))
        near = b * 40_503
        at1, at2 = slot + ((near >> 4) & (SLOTS - 1)), slot + (((a * 31_321 + near) >> 3) & (SLOTS - 1))
        e1, e2 = table1.take(at1), table2.take(at2)
        c1, c2 = e1 >> 2, e2 >> 2
        alike = c1 == c2
        at_state = state_row + (HELD.take(e2 & 3) * (c2 > 0) * 10 + HELD.take(e1 & 3) * (c1 > 0) * 2 + alike)
        at_class = class_row + SYMBOL.take(b + 1)
        p, q = by_state.take(at_state, axis=0), by_class.take(at_class, axis=0)
        mixed = p.view(np.uint16) + q.view(np.uint16)
        if ids is not None:
            v = ids[k, :m]
            w = v + 1
            symbol = np.where(w == c2, 0, np.where(w == c1, 1, SYMBOL.take(w)))
            coder.step(mixed, row, symbol, np.where(symbol > 1, w - FIRST.take(symbol), 0))
        else:
            symbol, rest = coder.step(mixed, row)
            w = np.where(symbol > 1, rest + FIRST.take(symbol), np.where(symbol == 1, c1, c2))
            np.copyto(out[k, :m], w - 1, casting="unsafe")
        p += (TOWARDS.take(symbol, axis=0) - p) >> 5
        q += (TOWARDS.take(symbol, axis=0) - q) >> 5
        by_state[at_state], by_class[at_class] = p, q
        new = (w << 2).astype(np.int32)
        table1[at1] = np.where(c1 == w, np.minimum(e1 + 1, e1 | 3), np.where(e1 & 2, e1 - 2, new))
        table2[at2] = np.where(c2 == w, np.minimum(e2 + 1, e2 | 3), np.where(e2 & 2, e2 - 2, new))
        a, b = b, (w - 1).astype(np.int64)
    return out


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    counts = np.array([len(x) for x in blocks], np.int64)
    order = np.argsort(-counts, kind="stable")
    ids = np.zeros((int(counts.max()), len(blocks)), np.int32)
    for k, at in enumerate(order.tolist()):
        ids[:counts[at], k] = blocks[at]
    if ids.size and (ids.min() < 0 or ids.max() > MOST):
        raise ValueError(f"ids must lie between 0 and {MOST}")
    coder = _Encoder(len(blocks), len(ids))
    _run(coder, counts[order], ids)
    words = coder.words()
    return [words[k] for k in np.argsort(order).tolist()]


def decode_blocks(words: list[bytes], counts: list[int]) -> list[np.ndarray]:
    n = np.array(counts, np.int64)
    order = np.argsort(-n, kind="stable")
    out = np.ascontiguousarray(_run(_Decoder([words[k] for k in order.tolist()]), n[order], None).T)
    return [out[k, :counts[at]] for k, at in zip(np.argsort(order).tolist(), range(len(counts)))]


def units(text: str) -> list[str]:
    """The text cut before each single space that surely stands between two other characters.

    A match of the pattern that reaches such a space starts with it, so the matches of
    the units are the matches of the text; few distinct units make up most text."""
    data, offsets = text_bytes(pa.array([text]))
    at = [*unit_starts(data, offsets).tolist(), len(data)] if text else []
    return [bytes(data[i:j]).decode() for i, j in zip(at, at[1:])]


class IdEncoder:
    """The ids of the tokenizers library. Units between single spaces are encoded once and kept;
    a text that holds one of the special strings, or a tokenizer that does not split there, is
    encoded whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_units = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
                         and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])))
        self.memo = Memo(MEMO)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_column(pa.array(texts, pa.string()))

    def encode_column(self, texts: pa.Array) -> list[np.ndarray]:
        """An array of ids per text."""
        whole = np.full(len(texts), not self.by_units)
        for special in self.special:
            whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        data, offsets = text_bytes(texts)
        starts = unit_starts(data, offsets) if len(data) else np.zeros(0, np.int64)
        firsts = np.searchsorted(starts, offsets)
        if whole.any():    # a single unit, which is not the memo's
            keep = np.ones(len(starts), bool)
            for k in np.flatnonzero(whole).tolist():
                keep[firsts[k] + 1:firsts[k + 1]] = False
            starts = starts[keep]
            firsts = np.searchsorted(starts, offsets)
        coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.r_[starts, len(data)].astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        kept, found = self.memo.get, coded.dictionary.to_pylist()
        known = [kept(u) for u in found]
        new = [k for k, ids in enumerate(known) if ids is None]
        for k, e in zip(new, self.tokenizer.encode_batch_fast([found[k] for k in new], add_special_tokens=False)):
            known[k] = array("I", e.ids).tobytes()
            if len(found[k]) <= 64:
                self.memo.put(found[k], known[k])
        lengths = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        code = coded.indices.to_numpy(zero_copy_only=False)
        each = lengths[code]
        ids = _gathered(np.frombuffer(b"".join(known), np.uint32), (np.cumsum(lengths) - lengths)[code], each)
        at = np.r_[0, np.cumsum(each)][firsts]
        return [ids[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


class _File:
    """One file being written: ids gather to ``LANES`` blocks, which are coded together."""

    def __init__(self, folder: str, name: str, attempt: int):
        self.filesystem, path = _filesystem(folder)
        self.final, self.part = f"{path}/{name}", f"{path}/.{name}.{attempt}"
        self.stream = self.filesystem.open_output_stream(self.part)
        self.stream.write(MAGIC)
        self.blocks, self.tables, self.room = [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            if not self.room:
                if len(self.blocks) == LANES:
                    self._write()
                self.blocks.append([])
                self.tables.append([])
                self.room = BLOCK
            n = min(self.room, len(ids) - at)
            self.blocks[-1].append(ids[at:at + n])
            at += n
            self.room -= n
            self.tables[-1].append(struct.pack(DOCUMENT, doc_id or 0, (doc_id is None) + 2 * (at == len(ids)), n))

    def _write(self) -> None:
        blocks = [np.concatenate(x) for x in self.blocks]
        for ids, table, words in zip(blocks, self.tables, encode_blocks(blocks)):
            docs = b"".join(table)
            start = struct.pack("<IIII", len(ids), len(table), len(words) // 4, zlib.crc32(ids.astype("<u4").tobytes()))
            self.stream.write(start + struct.pack("<I", zlib.crc32(docs, zlib.crc32(start))) + docs + words)
        self.blocks, self.tables, self.room = [], [], 0

    def close(self) -> None:
        if self.blocks:
            self._write()
        self.stream.close()
        self.filesystem.move(self.part, self.final)


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = 0) -> DataFrame:
    """Writes the files below ``folder``; returns ``(file, n_documents)``."""
    filesystem, where = _filesystem(folder)
    filesystem.create_dir(where)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), as_text().alias("text"))
    rows = rows.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        encoder, task = worker_state(("id_encoder", path), lambda: IdEncoder(path)), TaskContext.get()
        file, n, name = None, 0, f"part-{task.partitionId():05d}.ids"
        for batch in batches:
            for part in text_slices(batch, "text", 4 << 20):
                file = file or _File(folder, name, task.taskAttemptId())
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode_column(part.column(1))):
                    file.add(doc_id, np.append(ids, np.uint32(end_id)))
                    n += 1
        if file is not None:
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n_documents"])

    return materialise(bounded_batches(rows).mapInArrow(run, "file string, n_documents bigint"), "ids-manifest")


def read_file(data: bytes):
    """``(doc_id, ids)`` of each document of a file, in order."""
    if data[:len(MAGIC)] != MAGIC:
        raise ValueError("not a file of ids")
    at, held, open_ = len(MAGIC), [], []

    def documents(held):
        for (tables, _, crc, _), ids in zip(held, decode_blocks([h[3] for h in held], [h[1] for h in held])):
            if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise ValueError("a block's ids do not match their checksum")
            k = 0
            for doc_id, flags, n in tables:
                open_.append(ids[k:k + n])
                k += n
                if flags & 2:
                    yield None if flags & 1 else doc_id, np.concatenate(open_)
                    open_.clear()

    while at < len(data):
        if at + struct.calcsize(HEADER) > len(data):
            raise ValueError("file ends within a block")
        n, docs, words, crc, check = struct.unpack_from(HEADER, data, at)
        end = at + struct.calcsize(HEADER) + docs * struct.calcsize(DOCUMENT)
        if end + 4 * words > len(data) or zlib.crc32(data[at + struct.calcsize(HEADER):end], zlib.crc32(data[at:at + 16])) != check or not 0 < n <= BLOCK:
            raise ValueError("a block's header or document table is damaged")
        tables = list(struct.iter_unpack(DOCUMENT, data[at + struct.calcsize(HEADER):end]))
        held.append((tables, n, crc, data[end:end + 4 * words]))
        at = end + 4 * words
        if len(held) == LANES:
            yield from documents(held)
            held = []
    if held:
        yield from documents(held)
    if open_:
        raise ValueError("file ends within a document")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``(file_no, before, doc_id, ids)``: ``before`` counts the ids before the document in its
    file, ``ids`` is binary (little-endian unsigned 32-bit integers)."""
    files = (spark.read.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile")
                  .option("pathGlobFilter", "*.ids").load(folder)
                  .select(F.regexp_extract("path", r"part-(\d+)\.ids$", 1).cast("int").alias("file_no"), "content"))

    def run(batches):
        for batch in batches:
            for file_no, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held, before = [], 0, 0
                for doc_id, ids in read_file(content.as_py()):
                    rows.append((file_no, before, doc_id, ids.astype("<u4").tobytes()))
                    before += len(ids)
                    held += 4 * len(ids)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], names=NAMES)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], names=NAMES)

    return files.mapInArrow(run, "file_no int, before bigint, doc_id bigint, ids binary")


NAMES, KINDS = ["file_no", "before", "doc_id", "ids"], [pa.int32(), pa.int64(), pa.int64(), pa.binary()]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of all documents, from the files read back."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "ids")
    write_ids(docs, folder, path)
    rows = read_ids(spark, folder).select("file_no", "before", "doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    rows = materialise(rows, "ids-rows")
    ends = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))  # a row per file
    offsets = ends.select(F.col("file_no").alias("o_no"), (F.sum("n").over(Window.orderBy("file_no")) - F.col("n")).alias("offset"))
    return (rows.join(F.broadcast(offsets), F.col("file_no") == F.col("o_no"))
                .select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))
