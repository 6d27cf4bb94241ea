"""Syntax sequences of Python source rows.

Rows that are not Python or hold no code are settled by column expressions;
for the others an Arrow batch UDF runs the language's own parser, which no
Spark expression can stand in for, and lists the node types of the tree.
Names and literals do not occur in that list, so two sources that differ in
them alone share it; docstrings are left out. Errors are kept per row as text,
never raised. Sources of any length take part.
"""

from __future__ import annotations

import ast
import io
import tokenize
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOT_PYTHON = "not_python_or_no_code"
TRAVERSALS = ("preorder", "postorder", "bfs")
# Lexer classes that stand for their text, and tokens left out.
CLASSES = {tokenize.NAME: "NAME", tokenize.NUMBER: "NUM", tokenize.STRING: "STR"}
LEFT_OUT = {tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING, tokenize.COMMENT}


def _branches(node: ast.AST) -> list[ast.AST]:
    """Child nodes in source-field order, without a leading docstring. Literals
    count as text there (a leading bare number is dropped too), the ellipsis not."""
    kids = list(ast.iter_child_nodes(node))
    if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and node.body:
        head = node.body[0]
        if isinstance(head, ast.Expr) and isinstance(head.value, ast.Constant) and head.value.value is not ...:
            kids = [k for k in kids if k is not head]
    return kids


def node_types(code: str, traversal: str = "preorder") -> list[str]:
    """Node type names of the source's syntax tree; raises ``SyntaxError``."""
    queue, out = deque([ast.parse(code)]), []
    while queue:
        node = queue.popleft() if traversal == "bfs" else queue.pop()
        out.append(type(node).__name__)
        kids = _branches(node)
        # A postorder is the reverse of a preorder that takes the children from the right.
        queue.extend(reversed(kids) if traversal == "preorder" else kids)
    return out[::-1] if traversal == "postorder" else out


def token_classes(code: str) -> list[str]:
    """Lexer classes (NAME / NUM / STR / literal text); white-space words
    where even the lexer gives up."""
    try:
        tokens = list(tokenize.generate_tokens(io.StringIO(code).readline))
    except (tokenize.TokenError, SyntaxError):
        return code.split()
    return [CLASSES.get(t.type, t.string) for t in tokens if t.type not in LEFT_OUT]


def parse_row(code: str, traversal: str, fallback: bool) -> tuple[bool, str | None, list[str]]:
    """``(ok, err, node_types)`` of one source; never raises."""
    try:
        return True, None, node_types(code, traversal)
    except SyntaxError as e:
        if fallback:
            return True, f"SyntaxError_fallback:{e.msg}", token_classes(code)
        return False, f"SyntaxError:{e.msg}", []
    except (ValueError, RecursionError, MemoryError) as e:      # null bytes, nesting too deep
        return False, f"{type(e).__name__}:{e}", []


def canonicalize(df: DataFrame, traversal: str = "preorder", on_parse_error: str = "skip") -> DataFrame:
    """Adds ``parse_ok``, ``parse_err`` and ``node_types``; with
    ``on_parse_error="fallback"`` C2 stands in for sources that do not parse."""
    if traversal not in TRAVERSALS or on_parse_error not in ("skip", "fallback"):
        raise ValueError("unknown traversal or on_parse_error")
    fallback = on_parse_error == "fallback"

    @F.arrow_udf("struct<ok:boolean,err:string,rep:array<string>>")
    def parse(codes: pa.Array) -> pa.Array:
        rows = [parse_row(c, traversal, fallback) if c is not None else (False, None, []) for c in codes.to_pylist()]
        ok, err, rep = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(ok, pa.bool_()), pa.array(err, pa.string()), pa.array(rep, pa.list_(pa.string()))],
                                          names=["ok", "err", "rep"])

    code = F.coalesce(F.col("code_ref").cast("string"), F.lit(""))
    candidate = F.coalesce(F.col("language") == "python", F.lit(False)) & F.coalesce(F.col("has_code"), F.lit(False))
    parsed = df.withColumn("_c", parse.asNondeterministic()(F.when(candidate, code)))   # never duplicated into pushed-down filters
    return (parsed.withColumn("parse_ok", candidate & F.col("_c.ok"))
                  .withColumn("parse_err", F.when(candidate, F.col("_c.err")).otherwise(F.lit(NOT_PYTHON)))
                  .withColumn("node_types", F.col("_c.rep")).drop("_c"))


def with_canon_hash(df: DataFrame) -> DataFrame:
    """Exact-duplicate key; null unless ``parse_ok``."""
    return df.withColumn("canon_hash", F.when(F.col("parse_ok"), F.md5(F.array_join("node_types", "|"))))


def parse_report(df: DataFrame) -> DataFrame:
    """C4: rows by ``parse_ok`` and error class (text before the first ':')."""
    return df.groupBy("parse_ok", F.substring_index(F.coalesce("parse_err", F.lit("")), ":", 1).alias("err_class")) \
             .agg(F.count(F.lit(1)).alias("rows"))
