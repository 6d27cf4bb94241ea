"""Column expressions for text: Unicode strip, field extraction, word tokens.

Everything here returns a ``Column`` built from Spark built-ins, so it stays
inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip()`` removes (those with
# ``str.isspace()``), in code-point order. Spark's ``trim`` removes only the
# space, so ``py_strip`` trims exactly this set.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Word separator for the word-token binding: ASCII whitespace, spelled out so
# Spark (Java regex) and the SQL oracle (RE2) split identically.
WORD_SEP = "[ \\t\\n\\x0b\\x0c\\r]+"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: str | Column) -> Column:
    """Python ``str.strip()`` on a string column (null stays null)."""
    return F.btrim(col_of(c), F.lit(PY_WHITESPACE))


def extract_text(fields: Sequence[str | Column]) -> Column:
    """Each field cast to string and stripped; empty/null parts skipped;
    joined with newline; no parts gives null."""
    parts = [F.nullif(py_strip(col_of(f).cast("string")), F.lit("")) for f in fields]
    joined = F.concat_ws("\n", *parts)
    return F.nullif(joined, F.lit(""))


def stable_key(columns: Sequence[str], text: Column, id_candidates=("id", "uuid", "guid", "doc_id")) -> Column:
    """First non-null id column (among those present) as string, else the
    extracted text, else the empty string."""
    present = [F.col(c).cast("string") for c in id_candidates if c in columns]
    return F.coalesce(*present, text, F.lit(""))


ASCII_WS = " \t\n\x0b\x0c\r"


def words(text: str | Column) -> Column:
    """Lower-cased word tokens split on ASCII whitespace, empties dropped.

    Trimming first leaves empty strings only for an all-blank text, so no
    per-word lambda is needed."""
    t = F.btrim(F.lower(col_of(text)), F.lit(ASCII_WS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WORD_SEP))


def sql_py_strip(expr: str) -> str:
    """The same strip for the SQL oracle (DuckDB ``trim(s, chars)``); the set
    is spelled with ``chr`` so no control character sits in the SQL text."""
    chars = " || ".join("chr(%d)" % ord(ch) for ch in PY_WHITESPACE)
    return f"trim({expr}, {chars})"


SQL_WORDS = "list_filter(string_split_regex(lower({t}), '[ \\t\\n\\x0b\\x0c\\r]+'), lambda x: x <> '')"
