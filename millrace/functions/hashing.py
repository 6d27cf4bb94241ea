"""Hash expressions shared by split assignment, shuffles and MinHash."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MERSENNE31 = (1 << 31) - 1
I64_MAX = (1 << 63) - 1
U32_MAX = 0xFFFFFFFF


def md5_prefix_int(s: Column, hex_digits: int) -> Column:
    """Integer value of the first ``hex_digits`` hex digits of ``md5(s)``."""
    return F.conv(F.substring(F.md5(s), 1, hex_digits), 16, 10).cast("bigint")


def unit_interval(key: Column, seed: int) -> Column:
    """B7 hash: ``int(md5(f"{seed}:{key}")[:8], 16) / 0xFFFFFFFF``."""
    return md5_prefix_int(F.concat(F.lit(f"{seed}:"), key.cast("string")), 8).cast("double") / F.lit(float(U32_MAX))


def sql_unit_interval(key_sql: str, seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || CAST({key_sql} AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0)"


def shingle_base(s: Column) -> Column:
    """28-bit base value of a shingle (first 7 hex digits of its md5)."""
    return md5_prefix_int(s, 7)


@lru_cache(maxsize=None)
def universal_coefficients(num_perm: int, seed: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """``(a_i, b_i)`` for ``h_i(x) = (a_i * x + b_i) mod (2^31 - 1)``.

    Drawn from a seeded NumPy generator, so the same (num_perm, seed) always
    gives the same family; embedded into plans as literals.
    """
    rng = np.random.default_rng(seed)
    a = rng.integers(1, MERSENNE31, size=num_perm, dtype=np.int64)
    b = rng.integers(0, MERSENNE31, size=num_perm, dtype=np.int64)
    return tuple(int(x) for x in a), tuple(int(x) for x in b)
