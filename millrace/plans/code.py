"""Code rows derived from ``documents`` and the code dedup plan.

The driver tables hold no source code, so each document becomes one code
row: ``id = str(doc_id)``, ``dataset = source``, ``instruction = lang``,
``language = 'text'`` when ``doc_id % 5 = 0`` else ``'python'``,
``has_code = doc_id % 7 != 0`` and ``code_ref`` = template ``doc_id % 6``
with identifiers and literals varied by ``doc_id`` and the document's whole
text (quotes, backslashes and line breaks blanked) as a docstring or string
literal. Rows of one template share one AST sequence once docstrings,
names and literals are normalized, so the expected clusters are known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import ComponentsConfig, LSHConfig, MinHashConfig, SnapshotConfig
from millrace.operators.canon import canonicalize
from millrace.operators.components import cluster_map
from millrace.operators.lsh import band_keys, candidate_pairs
from millrace.operators.minhash import apply_minhash
from millrace.operators.snapshot import cluster_snapshot
from millrace.session import spread

# Fixed values of this binding: six templates ({n} = doc_id, {doc} = text).
TEMPLATES = (
    'def compute_{n}(value, scale={n}):\n    """{doc}"""\n    total = value * scale\n    return total + {n}\n',
    'class Item{n}:\n    """{doc}"""\n\n    def __init__(self, size):\n        self.size = size + {n}\n\n'
    '    def grow(self, step):\n        return self.size * step\n',
    'def walk_{n}(items):\n    acc = 0\n    for item in items:\n        if item > {n}:\n            acc += item\n'
    '    note = "{doc}"\n    return acc\n',
    'values_{n} = [x * {n} for x in range(10) if x % 2 == 0]\nlabel_{n} = "{doc}"\n',
    'async def fetch_{n}(client, key):\n    """{doc}"""\n    data = await client.get(key)\n    return data or {n}\n',
    'def broken_{n}(x:\n    note = "{doc}"\n    return x + {n}\n',
)


def code_rows(docs: DataFrame) -> DataFrame:
    d = spread(docs.select("doc_id", "source", "lang", "text"))
    n = F.col("doc_id").cast("string")
    doc = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r'[\\"\r\n]', " ")
    tpl = F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (F.pmod("doc_id", F.lit(len(TEMPLATES))) + 1).cast("int"))
    code = F.replace(F.replace(tpl, F.lit("{n}"), n), F.lit("{doc}"), doc)
    return d.select(
        F.col("source").alias("dataset"), n.alias("id"), F.col("lang").alias("instruction"),
        F.when(F.pmod("doc_id", F.lit(5)) == 0, F.lit("text")).otherwise(F.lit("python")).alias("language"),
        (F.pmod("doc_id", F.lit(7)) != 0).alias("has_code"),
        code.alias("code_ref"))


def canonical_rows(docs: DataFrame, on_parse_error: str = "skip") -> DataFrame:
    return canonicalize(code_rows(docs), on_parse_error=on_parse_error)


def code_snapshot(docs: DataFrame, mh: MinHashConfig = MinHashConfig(), lsh: LSHConfig = LSHConfig(),
                  comp: ComponentsConfig = ComponentsConfig(), snap: SnapshotConfig = SnapshotConfig()) -> DataFrame:
    """The dedup flow on code: node types -> MinHash -> LSH pairs -> components
    -> one row per cluster."""
    rows = canonical_rows(docs)
    sigs = apply_minhash(rows.select("id", "node_types", "parse_ok"), "node_types", mh, ok_col="parse_ok")
    cmap = cluster_map(candidate_pairs(band_keys(sigs, lsh)), comp)
    return cluster_snapshot(code_rows(docs), cmap, snap)
