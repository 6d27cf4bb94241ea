"""D1 shingles and D2 MinHash signatures.

Spark's interpreted array lambdas cost microseconds a shingle and hash, so
signatures are made by Arrow-batched UDFs over the token arrays: the n-grams of
some whole rows are joined in one Arrow call, ``md5`` gives each a 28-bit base
value, and NumPy takes the minima of each permutation over all of them with
``minimum.reduceat``. Repeated shingles do not change a minimum, so they stay.
``impl="native"`` keeps it in SQL expressions (``aggregate`` + ``zip_with``) for
comparison.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import MinHashConfig
from millrace.functions.hashing import I64_MAX, MERSENNE31, shingle_base, universal_coefficients

_CHUNK = 1 << 13   # shingle values per NumPy block, so that they stay in a core's cache


def shingles(tokens: Column, n: int) -> Column:
    """Distinct ``|``-joined n-grams of a token array; shorter -> [].

    Built from array slices, so tokens may be empty or hold any character."""
    m = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    grams = F.arrays_zip(*[F.slice(tokens, k + 1, m).alias(f"t{k}") for k in range(n)])
    return F.array_distinct(F.transform(grams, lambda g: F.concat_ws("|", *[g[f"t{k}"] for k in range(n)])))


def shingle_values(tokens: Column, n: int) -> Column:
    """Base value of every distinct shingle (``array<bigint>``)."""
    return F.transform(shingles(tokens, n), shingle_base)


def _perm_arrays(cfg: MinHashConfig) -> tuple[np.ndarray, np.ndarray]:
    a, b = universal_coefficients(cfg.num_perm, cfg.seed0)
    return np.array(a, dtype=np.int64)[:, None], np.array(b, dtype=np.int64)[:, None]


def _blocks(lens: np.ndarray) -> Iterator[np.ndarray]:
    """The rows that are not empty, in blocks of whole rows of about ``_CHUNK`` values."""
    rows = np.flatnonzero(lens)
    before = np.r_[0, np.cumsum(lens[rows])]
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(before, before[i] + _CHUNK, side="right")) - 1)
        yield rows[i:j]
        i = j


def _permuted_minima(values: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``min((a * x + b) mod (2^31 - 1))`` of each run of values, a column per permutation.

    2^31 is 1 in that field: the high bits are added to the low ones, after which one subtraction is
    left; it wraps above the value where it must not be done."""
    p, shift = np.uint64(MERSENNE31), np.uint64(31)
    x = (values % MERSENNE31).astype(np.uint64)
    out = np.empty((len(starts), a.shape[0]), np.int64)
    h, carry = np.empty_like(x), np.empty_like(x)
    for k, (ak, bk) in enumerate(zip(a.ravel().astype(np.uint64), b.ravel().astype(np.uint64))):
        np.multiply(x, ak, out=h)
        np.add(h, bk, out=h)
        np.right_shift(h, shift, out=carry)
        np.bitwise_and(h, p, out=h)
        np.add(h, carry, out=h)
        np.subtract(h, p, out=carry)
        np.minimum(h, carry, out=h)
        out[:, k] = np.minimum.reduceat(h, starts)
    return out


def _as_lists(out: np.ndarray) -> pa.ListArray:
    n, k = out.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k, dtype=np.int32)), pa.array(out.ravel()))


def batch_signatures(values: pa.ListArray, a: np.ndarray, b: np.ndarray) -> pa.ListArray:
    """Signatures for a batch of base-value lists (empty list -> all 2^63-1)."""
    offsets = values.offsets.to_numpy()
    flat = values.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    out = np.full((len(values), a.shape[0]), I64_MAX, dtype=np.int64)
    for rows in _blocks(np.diff(offsets)):
        lo, hi = offsets[rows[0]], offsets[rows[-1] + 1]
        out[rows] = _permuted_minima(flat[lo:hi], offsets[rows] - lo, a, b)
    return _as_lists(out)


def _token_signatures(tokens: pa.Array, n: int, k: int, minima: Callable[[list[bytes], np.ndarray], np.ndarray]) -> pa.ListArray:
    """Signatures of token lists: ``minima`` gets the n-grams of some rows, and where each row's begin."""
    size = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, flat, lens = np.cumsum(size) - size, tokens.flatten(), np.maximum(size - (n - 1), 0)
    out = np.full((len(tokens), k), I64_MAX, dtype=np.int64)
    bar = pa.scalar(b"|", pa.large_binary())
    for rows in _blocks(lens):
        lo, hi = int(at[rows[0]]), int(at[rows[-1]] + size[rows[-1]])
        part, m = flat.slice(lo, hi - lo).cast(pa.large_binary()), hi - lo - (n - 1)
        grams = pc.binary_join_element_wise(*[part.slice(i, m) for i in range(n)], bar, null_handling="skip")
        ends = np.frombuffer(grams.buffers()[1], np.int64)[grams.offset:grams.offset + m + 1].tolist()
        data, starts = grams.buffers()[2].to_pybytes() if ends[-1] else b"", np.cumsum(lens[rows]) - lens[rows]
        strings = [data[ends[i]:ends[i + 1]] for r in rows.tolist() for i in range(int(at[r]) - lo, int(at[r]) - lo + int(lens[r]))]
        out[rows] = minima(strings, starts)
    return _as_lists(out)


def _arrow_signature(cfg: MinHashConfig):
    a, b = _perm_arrays(cfg)

    def minima(strings: list[bytes], starts: np.ndarray) -> np.ndarray:
        heads = np.frombuffer(b"".join([hashlib.md5(s).digest()[:4] for s in strings]), ">u4")
        return _permuted_minima((heads >> 4).astype(np.int64), starts, a, b)      # 7 hex digits

    @F.arrow_udf("array<bigint>")
    def minhash_udf(tokens: pa.Array) -> pa.Array:
        return _token_signatures(tokens, cfg.shingle_n, cfg.num_perm, minima)

    # Marked non-deterministic only so Catalyst never copies the call into a
    # pushed-down filter (which would run it twice); its output is a pure
    # function of the input.
    return minhash_udf.asNondeterministic()


def signature_native(base: Column, cfg: MinHashConfig) -> Column:
    """Same signature as SQL expressions: one pass over the base values,
    folding 128 running minima with ``zip_with``."""
    a, b = universal_coefficients(cfg.num_perm, cfg.seed0)
    perm = F.arrays_zip(F.array(*[F.lit(x).cast("bigint") for x in a]).alias("a"),
                        F.array(*[F.lit(x).cast("bigint") for x in b]).alias("b"))
    p = F.lit(MERSENNE31).cast("bigint")
    start = F.array_repeat(F.lit(I64_MAX).cast("bigint"), cfg.num_perm)
    return F.aggregate(base, start, lambda acc, x: F.zip_with(
        acc, perm, lambda m, ab: F.least(m, (ab["a"] * x + ab["b"]) % p)))


def _xxhash_signature(cfg: MinHashConfig):
    """``xxhash64`` family: a 64-bit hash per (permutation, shingle), masked to
    63 bits; for corpora where 28-bit base values collide. The values are those
    of Spark's ``xxhash64(permutation, shingle)``."""
    def minima(strings: list[bytes], starts: np.ndarray) -> np.ndarray:
        from xxhash import xxh64_intdigest

        out = np.empty((len(starts), cfg.num_perm), np.int64)
        for k in range(cfg.num_perm):
            seed = xxh64_intdigest(struct.pack("<i", k + cfg.seed0), 42)
            h = np.array([xxh64_intdigest(s, seed) for s in strings], np.uint64) & np.uint64(I64_MAX)
            out[:, k] = np.minimum.reduceat(h, starts)
        return out

    @F.arrow_udf("array<bigint>")
    def xxhash_udf(tokens: pa.Array) -> pa.Array:
        return _token_signatures(tokens, cfg.shingle_n, cfg.num_perm, minima)

    return xxhash_udf.asNondeterministic()


def apply_minhash(df: DataFrame, tokens_col: str, cfg: MinHashConfig = MinHashConfig(),
                  ok_col: str | None = None, impl: str = "arrow") -> DataFrame:
    """Adds ``sig_ok`` and ``sig`` (``array<bigint>``, length num_perm).

    ``sig_ok`` is false when ``ok_col`` (e.g. ``parse_ok``) is false/missing or
    the token array is shorter than the shingle size; then ``sig`` is all
    ``2^63-1``, as the reference stage writes it.
    """
    toks = F.coalesce(F.col(tokens_col), F.array().cast("array<string>"))
    ok = F.size(toks) >= cfg.shingle_n
    if ok_col is not None:
        ok = ok & F.coalesce(F.col(ok_col), F.lit(False))
    out = df.withColumn("sig_ok", ok)
    if cfg.hash_family == "xxhash64":
        return out.withColumn("sig", _xxhash_signature(cfg)(F.when(ok, toks)))
    if cfg.hash_family != "universal31":
        raise ValueError(f"unknown hash_family {cfg.hash_family!r}")
    if impl == "native":
        base = F.when(ok, shingle_values(toks, cfg.shingle_n)).otherwise(F.array().cast("array<bigint>"))
        return out.withColumn("sig", signature_native(base, cfg))
    if impl != "arrow":
        raise ValueError(f"unknown impl {impl!r}")
    return out.withColumn("sig", _arrow_signature(cfg)(F.when(ok, toks)))
