"""Independent DuckDB SQL for the dedup chain (the correctness oracle).

Set-based and brute force: signatures by ``unnest`` x permutation table,
components by a recursive closure. Fine at the oracle's scale, never used
by the Spark jobs.
"""

from __future__ import annotations

from millrace.config import LSHConfig, MinHashConfig
from millrace.functions.hashing import MERSENNE31, universal_coefficients
from millrace.functions.text import SQL_WORDS


def chain_ctes(mh: MinHashConfig = MinHashConfig(), lsh: LSHConfig = LSHConfig()) -> str:
    """CTEs: docs, sh, x, ab, sig, band, stats, mem, pairs, e, c, cmap, rws."""
    n = mh.shingle_n
    r = lsh.k // lsh.b
    a, b = universal_coefficients(mh.num_perm, mh.seed0)
    ab_rows = ", ".join(f"({i}, {ai}, {bi})" for i, (ai, bi) in enumerate(zip(a, b)))
    words = SQL_WORDS.format(t="text")
    return f"""
docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, {words} AS t FROM documents),
sh AS (SELECT id, list_distinct(list_transform(range(1, len(t) - {n} + 2),
              lambda i: array_to_string(t[i:i + {n - 1}], '|'))) AS s
       FROM docs WHERE len(t) >= {n}),
x AS (SELECT id, unnest(list_transform(s, lambda z: ('0x' || substr(md5(z), 1, 7))::BIGINT)) AS v FROM sh),
ab(i, a, b) AS (VALUES {ab_rows}),
sig AS (SELECT id, i, min((a * v + b) % {MERSENNE31}) AS m FROM x, ab GROUP BY id, i),
band AS (SELECT id, CAST(i // {r} AS INTEGER) AS band,
                md5(string_agg(CAST(m AS VARCHAR), ',' ORDER BY i)) AS key
         FROM sig GROUP BY id, i // {r}),
stats AS (SELECT band, key, count(*) AS n, min(id) AS center FROM band
          GROUP BY band, key HAVING count(*) >= 2),
mem AS (SELECT bd.id, bd.band, bd.key, st.n, st.center FROM band bd JOIN stats st USING (band, key)),
pairs AS (SELECT DISTINCT center AS id1, id AS id2 FROM mem WHERE id <> center),
e AS (SELECT id1 AS a, id2 AS b FROM pairs UNION SELECT id2, id1 FROM pairs),
c(a, b) AS (SELECT a, a FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
cmap AS (SELECT a AS id, md5(min(b)) AS cluster_id FROM c GROUP BY a),
rws AS (SELECT d.source AS dataset, CAST(d.doc_id AS VARCHAR) AS id, d.lang AS instruction,
               d.text AS code_ref, 'text' AS language, true AS has_code,
               coalesce(cm.cluster_id, md5(CAST(d.doc_id AS VARCHAR))) AS cluster_id
        FROM documents d LEFT JOIN cmap cm ON CAST(d.doc_id AS VARCHAR) = cm.id)
"""


def with_chain(select: str, mh: MinHashConfig = MinHashConfig(), lsh: LSHConfig = LSHConfig()) -> str:
    return "WITH RECURSIVE " + chain_ctes(mh, lsh).strip() + "\n" + select


SNAPSHOT_SELECT = """
SELECT dataset, id, instruction, code_ref, language, has_code, cluster_id FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id
           ORDER BY length(coalesce(code_ref, '')) DESC, length(coalesce(instruction, '')) DESC,
                    md5(coalesce(id, '')) ASC) AS rn
  FROM rws WHERE cluster_id IS NOT NULL AND cluster_id <> '') q
WHERE rn = 1
"""
