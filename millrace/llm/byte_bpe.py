"""Byte-level BPE encoding and decoding by rank files.

Bytes are mapped to Latin-1 characters so that one Aho-Corasick automaton holds the
vocabulary and finds the longest entry at a place. The encoder walks from left to right
taking the longest entry at each place; an entry may follow another only when the
two are *compatible*, i.e. when merging their joined bytes by rank gives exactly
the two back. Where no compatible entry is left the walk steps back and takes the
next shorter one; places found dead stay dead, so each is left at most once and the
walk is linear in the piece. A sequence whose neighbours are all compatible is the
sequence that merging by rank gives. Compatibility is memoised per pair.

A batch's texts are cut into units, short strings of which few are distinct; distinct units alone
are encoded, and the ids of the texts are gathered from theirs. Decoding gathers the entries' bytes.
``round_trip`` does both in one pass with one codec.

Rows: one per input row. Null text counts as empty (no ids). Repeated rows give
repeated results; an empty table gives an empty one; other columns are not read, so
their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import as_text, bounded_batches, text_slices, worker_state
from millrace.llm.shingle_sets import text_bytes

#: Entries of a generation of a worker's memos (memory bound, not a limit on results): a worker stays
#: alive between stages, so what it keeps counts against its executor's memory there too.
UNITS, PIECES, PAIRS = 100_000, 200_000, 500_000
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Bytes that surely belong to a character other than white space: printable ASCII, and the first bytes
#: of two-byte characters from U+00C0 on.
PRINTED = np.zeros(256, bool)
PRINTED[0x21:0x7F] = True
LEAD = np.zeros(256, bool)
LEAD[0xC3:0xE0] = True


@lru_cache(maxsize=None)
def _ranges(kind: str) -> str:
    """The BMP characters of a general category as ranges for a character class."""
    out, first = [], None
    for c in range(0x10001):
        hit = c < 0x10000 and not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == kind
        if hit and first is None:
            first = c
        elif not hit and first is not None:
            out.append(f"\\u{first:04x}-\\u{c - 1:04x}")
            first = None
    return "".join(out)


def _bmp_pattern(pattern: str) -> re.Pattern:
    """The same pattern for ``re``, which is faster, for text within the BMP."""
    for a, b in (("[^\\s\\p{L}\\p{N}]", f"[^{WHITE}{_ranges('L')}{_ranges('N')}]"), ("\\p{L}", f"[{_ranges('L')}]"),
                 ("\\p{N}", f"[{_ranges('N')}]"), ("\\S", f"[^{WHITE}]"), ("\\s", f"[{WHITE}]")):
        pattern = pattern.replace(a, b)
    return re.compile(pattern)


class Splitter:
    """``pieces(text)``: the matches of the pattern, as the public library finds them."""

    def __init__(self, pattern: str):
        self.every = regex.compile(pattern.replace("\\S", "\\P{White_Space}").replace("[^\\s", "[^\\p{White_Space}")
                                   .replace("\\s", "\\p{White_Space}"))
        self.bmp = _bmp_pattern(pattern)

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or max(text) <= "\uffff":
            return self.bmp.findall(text)
        return self.every.findall(text)


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the units of the texts begin: at each text, and at each single space that stands between
    two characters that surely are not white space.

    A match of the pattern that reaches such a space starts with it, so the matches of the units are the
    matches of the text, wherever else there might have been a cut."""
    n = len(data)
    cut = data == 0x20
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = PRINTED[data[:-1]]
    before[2:] |= LEAD[data[:-2]] & (data[1:-1] >= 0x80)
    after[:-1] = PRINTED[data[1:]] | LEAD[data[1:]]
    cut &= before & after
    edge = offsets[:-1][np.diff(offsets) > 0]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    cut[last] = False      # what follows is another text's
    cut[edge] = True
    return np.flatnonzero(cut)


class Memo:
    """A dictionary of two generations: when the new one is full the old one goes, so what is met
    again and again stays."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def get(self, key):
        if key in self.new:
            return self.new[key]
        if (known := self.old.get(key)) is not None:
            self.put(key, known)
        return known

    def put(self, key, value) -> None:
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        self.new[key] = value


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The values of several ranges, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class RankVocabulary:
    """The entries of a rank file; all that decoding needs."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {i: t for t, i in self.ranks.items()}
        self.known = np.zeros(max(self.token, default=-1) + 1, bool)
        self.known[list(self.token)] = True
        self.lengths = np.array([len(self.token.get(i, b"")) for i in range(len(self.known))], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(len(self.known))), np.uint8)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for; an id that is not in the vocabulary is an error."""
        ids = np.frombuffer(ids, "<u4").astype(np.int64)
        if len(ids) and (ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return _gathered(self.flat, self.starts[ids], self.lengths[ids]).tobytes()


class RankBPE(RankVocabulary):
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str):
        super().__init__(path)
        self.splitter = Splitter(pattern)
        # Entries that merging does not reproduce can only stand for a whole piece.
        self.sound, self.halves = {}, {}
        for t, i in self.ranks.items():
            parts = self._merged(t)
            if len(t) == 1 or len(parts) == 2:
                self.sound[t] = i
                if len(t) > 1:
                    self.halves[t] = (parts[0], parts[1])
        self.automaton = ahocorasick.Automaton()
        for t, i in self.sound.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.reach = max(map(len, self.sound))
        self.size = {i: len(t) for t, i in self.sound.items()}
        self.shorter_memo: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.piece_memo, self.unit_memo = Memo(PIECES), Memo(UNITS)

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return struct.pack(f"<{len(ids)}I", *ids)

    def _merged(self, data: bytes) -> list[bytes]:
        """Merging by rank, up to but without the merge that would give the whole."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 2:
            best, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves the two entries, side by side, as they are.

        Going back in time from the finished entries, the later made of the two halves that meet
        is taken apart; they would have been merged if their joined rank came before the merge
        that used them up. Of equal ranks the left merge comes first, so a merge across the
        border gives way to one inside the left entry and wins over one inside the right."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ranks, halves = self.ranks, self.halves
            left, right, before, known = self.token[a], self.token[b], 1 << 60, True
            while True:
                across = ranks.get(left + right)
                if across is not None and across < before:
                    known = False
                    break
                if left in halves and (right not in halves or ranks[left] > ranks[right]):
                    before, left = ranks[left], halves[left][1]
                elif right in halves:
                    before, right = ranks[right] + 1, halves[right][0]
                else:
                    break
            self.pairs[key] = known
        return known

    def shorter(self, i: int) -> int:
        """The longest entry that is a proper prefix of entry ``i``; -1 without one."""
        known = self.shorter_memo.get(i)
        if known is None:
            t = self.token[i]
            known = self.shorter_memo[i] = next((self.sound[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.sound), -1)
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None or not data:
            return [] if whole is None else [whole]
        latin, prefix, sound, size_of, pairs = data.decode("latin-1"), self.automaton.longest_prefix, self.sound, self.size, self.pairs
        n, reach = len(data), self.reach
        dead, ids, at, last, now = bytearray(n + 1), [], 0, -1, -1
        while at < n:
            if now < 0:     # the longest entry that starts here: the automaton's longest path, or the last entry on it
                size = prefix(latin[at:at + reach])
                while (now := sound.get(data[at:at + size], -1)) < 0:
                    size -= 1
            else:
                size = size_of[now]
            if not dead[at + size]:
                if last < 0:
                    fits = True
                elif (fits := pairs.get(last << 32 | now)) is None:
                    fits = self.compatible(last, now)
                if fits:
                    ids.append(now)
                    at += size
                    last, now = now, -1
                    continue
            now = self.shorter(now)
            while now < 0:  # nothing fits here: leave this place for good
                dead[at] = 1
                last = ids.pop()
                at -= size_of[last]
                now = self.shorter(last)
                last = ids[-1] if ids else -1
        return ids

    def _piece(self, piece: str) -> bytes:
        known = self.piece_memo.get(piece)
        if known is None:
            known = self.packed(self.encode_piece(piece.encode()))
            if len(piece) <= 64:
                self.piece_memo.put(piece, known)
        return known

    def _unit(self, unit: str) -> bytes:
        """The ids of a unit that the memo does not hold."""
        pieces = self.splitter.pieces(unit)
        known = self._piece(unit) if len(pieces) == 1 else b"".join([self._piece(p) for p in pieces])
        if len(unit) <= 64:
            self.unit_memo.put(unit, known)
        return known

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        data, offsets = text_bytes(texts)
        starts = unit_starts(data, offsets) if len(data) else np.zeros(0, np.int64)
        coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.r_[starts, len(data)].astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        kept, make = self.unit_memo.get, self._unit
        known = [make(u) if (ids := kept(u)) is None else ids for u in coded.dictionary.to_pylist()]
        lengths = np.array([len(x) // 4 for x in known], np.int64)
        code = coded.indices.to_numpy(zero_copy_only=False)
        each = lengths[code]
        ids = _gathered(np.frombuffer(b"".join(known), "<u4"), (np.cumsum(lengths) - lengths)[code], each).tobytes()
        at = 4 * np.r_[0, np.cumsum(each)][np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def encode(self, text: str) -> bytes:
        return self.encode_column(pa.array([text]))[0]


def _codec(path: str, pattern: str) -> RankBPE:
    return worker_state(("rank_bpe", path, pattern), lambda: RankBPE(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: ``ids`` is binary, little-endian unsigned 32-bit integers."""
    rows = docs.select(F.col(id_col), as_text(text_col).alias("text"))

    def run(batches):
        codec = _codec(path, pattern)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids = codec.encode_column(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    kind = rows.schema[0].dataType.simpleString()
    return bounded_batches(rows).mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes the ids stand for."""
    rows = encoded.select(F.col(id_col), F.col("ids"))

    def run(batches):
        codec = worker_state(("rank_vocabulary", path), lambda: RankVocabulary(path))
        for batch in batches:
            for part in text_slices(batch, "ids"):
                out = [codec.decode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[id_col, "ids", "decoded"])

    kind = rows.schema[0].dataType.simpleString()
    return bounded_batches(rows).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``."""
    return decoded.select(F.col(id_col), (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``digests(decode(encode(docs)))`` in one pass, after ``n_tokens`` the ids where asked for."""
    rows = docs.select(F.col(id_col), as_text(text_col).alias("text"))
    names = [id_col, "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"]

    def run(batches):
        codec = _codec(path, pattern)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids = codec.encode_column(part.column(1))
                sums = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in (ids, map(codec.decode, ids))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *([pa.array(ids, pa.binary())] if with_ids else []),
                                                  *(pa.array(x, pa.string()) for x in sums)], names=names)

    kind = rows.schema[0].dataType.simpleString()
    return bounded_batches(rows).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, {'ids binary, ' if with_ids else ''}ids_sha256 string, decoded_sha256 string")
