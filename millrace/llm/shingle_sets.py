"""Word shingle sets of an Arrow column of texts, computed over whole batches in NumPy.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. A word's 64-bit hash
comes from running sums of random byte values times powers of an odd constant, so no Python
code runs per word; a shingle's hash mixes its words' hashes in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_R = np.random.default_rng(20_240_501)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
BYTE_VALUE = _R.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
BYTE_VALUE[WHITE] = 0


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and the offsets of the texts in it; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and the offsets of the texts among them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    black = ~WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(black & np.r_[True, ~black[:-1] | edge[1:n]])
    ends = np.flatnonzero(black & np.r_[~black[1:] | edge[1:n], True])
    sums = np.cumsum(BYTE_VALUE[data] * powers(_STEP, n))
    inverse = powers(_STEP_INVERSE, n)[starts]
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    hashes = mix((sums[ends] - before) * inverse + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A text of fewer words than ``width``
    has its whole sequence as one shingle, one without words none."""
    words, at = word_hashes(*text_bytes(column))
    n = max(0, len(words) - width + 1)
    shingles = np.zeros(n, np.uint64)
    for k in range(width):
        shingles = shingles * _STEP + words[k:k + n]
    shingles = mix(shingles)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            s = np.sort(shingles[a:b - width + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            x = np.uint64(b - a)
            for w in words[a:b]:
                x = mix(np.array([x]) * _STEP + w)[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
