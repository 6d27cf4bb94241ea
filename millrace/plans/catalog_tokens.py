"""Catalog entries for B* (rows, split) and E* (positions, budget, shards,
samples) over ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.config import SplitConfig
from millrace.functions.hashing import sql_unit_interval
from millrace.functions.text import SQL_WORDS, sql_py_strip, words
from millrace.operators import fileorder as fo
from millrace.operators import packing as pk
from millrace.operators import rows as rw
from millrace.operators import shards as sh
from millrace.operators.position import global_positions
from millrace.operators.split import split_sources, with_split, with_text
from millrace.plans import tokens as tk
from millrace.plans.catalog import register, table
from millrace.session import cut_lineage
from millrace.sources.corpus import scratch_path

SPLIT = SplitConfig(val_fraction=0.05, seed=42)
BUDGET = {"train": 150_000, "val": 5_000}
SHARD_BYTES = 65_536
PAD_BATCH, PAD_MAX_LEN = 4, 64
SEQ_LEN, STRIDE = 128, 64


def _text_x(col: str) -> str:
    return f"NULLIF({sql_py_strip(f'CAST({col} AS VARCHAR)')}, '')"


def _split_case(key: str) -> str:
    return f"CASE WHEN {SPLIT.val_fraction} > 0 AND {sql_unit_interval(key, SPLIT.seed)} < {SPLIT.val_fraction} THEN 'val' ELSE 'train' END"


def _ids(t: str) -> str:
    words = SQL_WORDS.format(t=t)
    return f"list_transform({words}, lambda w: CAST(('0x' || substr(md5(w), 1, 3))::BIGINT + 4 AS INTEGER))"


ENC = f"""
sd AS (SELECT doc_id, {_text_x('text')} AS text_x FROM documents),
enc AS (SELECT doc_id, {_split_case('doc_id')} AS split, text_x, {_ids('text_x')} || [3] AS ids
        FROM sd WHERE text_x IS NOT NULL),
ord AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS pos,
               CAST(coalesce(sum(len(ids)) OVER (PARTITION BY split ORDER BY doc_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum_before
        FROM enc)
"""


def _with(body: str, extra: str = "") -> str:
    return "WITH RECURSIVE " + ENC.strip() + (",\n" + extra.strip() if extra else "") + "\n" + body


def _arr(c):
    return F.array_join(F.col(c).cast("array<string>"), " ")


def _sql_arr(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"


# ------------------------------------------------------------------ B rows

@register("b1_debug_limit", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 2000")
def q_b1(spark, sf):
    return rw.debug_limit(table(spark, sf, "documents"), 2000, ["doc_id"]).select("doc_id")


@register("b2_prefix_samples",
          "SELECT s.sample_size, d.doc_id, d.rank FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank "
          "FROM documents) d JOIN (VALUES (100), (500)) s(sample_size) ON d.rank <= s.sample_size")
def q_b2(spark, sf):
    return rw.prefix_samples(table(spark, sf, "documents").select("doc_id"), [100, 500], ["doc_id"]) \
             .select("sample_size", "doc_id", F.col("rank").cast("bigint").alias("rank"))


FILE_ROWS, BUFFER, BLOCK_FILES = 50, 100, 400


def _in_files(spark, sf, rows: int | None = FILE_ROWS):
    """The documents in several files: a folder per language, in it files by doc_id, of ``rows`` rows or as
    tasks write them. No task holds a whole language: range partitions of the order follow one another, and
    so do their files' names. For files of ``rows`` rows, a task writes a block of whole files."""
    path = scratch_path(spark, "corpus-files")
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    if rows is None:
        d = d.repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id")
        d.write.partitionBy("lang").parquet(path)
        return fo.read_placed(spark, path)
    d = d.select("*", F.col("_metadata.file_path").alias("__at"), F.col("_metadata.row_index").alias("__no"))
    keys = global_positions(d.select("doc_id", "lang", "__at", "__no"), ["doc_id", "__at", "__no"], group_cols=["lang"])
    keys = cut_lineage(keys.select("__at", "__no", "pos", F.col("lang").alias("__lang"), F.floor(F.col("pos") / (rows * BLOCK_FILES)).alias("__block")))
    blocks = global_positions(keys.select("__lang", "__block").distinct(), ["__lang", "__block"], pos_col="__task").drop("cum_before")
    blocks = cut_lineage(blocks)                        # a row per BLOCK_FILES files
    keys = sh._join_on(keys, blocks, ["__lang", "__block"]).select("__at", "__no", "pos", "__task")
    placed = d.join(keys, ["__at", "__no"]).select("doc_id", "text", "lang", "pos", "__task")
    placed = placed.repartitionById(max(1, blocks.count()), F.col("__task").cast("int")).sortWithinPartitions("lang", "pos")
    placed.select("doc_id", "text", "lang").write.option("maxRecordsPerFile", rows).partitionBy("lang").parquet(path)
    return fo.read_placed(spark, path)


_FILE_ORDER = "row_number() OVER (ORDER BY lang, doc_id) - 1"
_FILE_ROW = f"(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % {FILE_ROWS}"


@register("b2_file_samples",
          f"SELECT s.sample_size, d.doc_id, md5(d.text) AS text_md5, d.row, d.pos + 1 AS rank FROM (SELECT doc_id, text, {_FILE_ORDER} AS pos, "
          f"{_FILE_ROW} AS row FROM documents) d JOIN (VALUES (100), (10000)) s(sample_size) ON d.pos < s.sample_size")
def q_b2f(spark, sf):
    return fo.file_prefix_samples(_in_files(spark, sf), [100, 10_000]) \
             .select("sample_size", "doc_id", F.md5("text").alias("text_md5"), "row", "rank")


def _folder(file):
    return F.regexp_extract(file, "^(.*)/", 1)


@register("b9_file_shuffle",
          f"SELECT doc_id, row_number() OVER (ORDER BY md5('{42 + fo.ROLE_OFFSET['train']}:lang=' || lang), doc_id) - 1 AS pos FROM documents")
def q_b9f(spark, sf):
    """Languages in hashed order, by the names of their folders: the writer's own names differ in each run.
    A folder's files follow one another."""
    order = fo.by_hash(fo.role_seed(42, "train"))
    placed = fo.file_positions(_in_files(spark, sf, None), lambda file: order(_folder(file)))
    return placed.select("doc_id", "pos")


@register("b9_buffer_shuffle",
          f"SELECT doc_id, pos, row_number() OVER (ORDER BY pos + least(CAST(floor({sql_unit_interval('pos', 7)} * {BUFFER}) AS BIGINT), {BUFFER} - 1), "
          f"md5('7:' || pos), pos) - 1 AS shuffled_pos FROM (SELECT doc_id, {_FILE_ORDER} AS pos FROM documents) d")
def q_b9b(spark, sf):
    placed = fo.file_positions(_in_files(spark, sf)).select("doc_id", "pos")
    return fo.buffer_shuffle(placed, 7, BUFFER).select("doc_id", "pos", "shuffled_pos")


@register("b5_extract_text",
          f"SELECT conv_id, turn, NULLIF(concat_ws(chr(10), {_text_x('role')}, {_text_x('text')}), '') AS text_x "
          "FROM conversations")
def q_b5(spark, sf):
    return with_text(table(spark, sf, "conversations"), ["role", "text"]).select("conv_id", "turn", "text_x")


@register("b7_assign_split",
          f"SELECT doc_id, CAST(doc_id AS VARCHAR) AS split_key, {sql_unit_interval('doc_id', SPLIT.seed)} AS u, "
          f"{_split_case('doc_id')} AS split FROM documents")
def q_b7(spark, sf):
    d = with_split(table(spark, sf, "documents").select("doc_id", "text"), SPLIT, key_col="doc_id")
    return d.select("doc_id", "split_key", "u", "split")


_CONV_TEXT = _text_x("text")


@register("b6_stable_key_text",
          f"SELECT conv_id, turn, coalesce({_CONV_TEXT}, '') AS split_key, "
          f"{sql_unit_interval(f'coalesce({_CONV_TEXT}, {chr(39) * 2})', SPLIT.seed)} AS u FROM conversations")
def q_b6(spark, sf):
    # conversations has no id/uuid/guid/doc_id column, so the key is the text
    d = with_split(with_text(table(spark, sf, "conversations").select("conv_id", "turn", "text"), ["text"]), SPLIT)
    return d.select("conv_id", "turn", "split_key", "u")


@register("b8_cap_samples",
          _with(f"SELECT doc_id, split FROM enc ORDER BY doc_id LIMIT 300"))
def q_b8(spark, sf):
    return rw.cap_samples(tk.split_docs(table(spark, sf, "documents"), SPLIT), 300, ["doc_id"]).select("doc_id", "split")


@register("b9_seeded_shuffle",
          "SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS pos FROM documents")
def q_b9(spark, sf):
    return rw.seeded_shuffle(table(spark, sf, "documents").select("doc_id"), "doc_id", 7).select("doc_id", "pos")


@register("b10_extract_sentences",
          f"SELECT conv_id, turn, line_no, sentence FROM (SELECT conv_id, turn, "
          f"generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, "
          f"unnest(string_split(text, chr(10))) AS line FROM conversations) q, "
          f"LATERAL (SELECT {sql_py_strip('line')} AS sentence) s WHERE sentence <> ''")
def q_b10(spark, sf):
    return rw.extract_sentences(table(spark, sf, "conversations"), "text", ["conv_id", "turn"]) \
             .select("conv_id", "turn", F.col("line_no").cast("bigint").alias("line_no"), "sentence")


@register("b11_shard_rows",
          "SELECT doc_id, pos, CAST((pos % 8) // 2 AS INTEGER) AS rank, CAST(pos % 2 AS INTEGER) AS worker FROM "
          "(SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) q")
def q_b11(spark, sf):
    p = global_positions(table(spark, sf, "documents").select("doc_id"), ["doc_id"])
    return rw.shard_rows(p, 4, 2).select("doc_id", "pos", "rank", "worker")


@register("b12_equal_split",
          "SELECT doc_id, CAST(pos // (n // 3) AS INTEGER) AS rank FROM "
          "(SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) q "
          "WHERE pos // (n // 3) < 3")
def q_b12(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    p = global_positions(d, ["doc_id"])
    return rw.equal_split(p, 3, d.count()).select("doc_id", "rank")


@register("b13_batch_rows",
          "SELECT CAST(pos // 8 AS BIGINT) AS batch, CAST(count(*) AS INTEGER) AS batch_rows, "
          "md5(string_agg(text, chr(1) ORDER BY pos)) AS texts_md5 FROM "
          "(SELECT text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos FROM conversations) q "
          "GROUP BY pos // 8 HAVING count(*) = 8")
def q_b13(spark, sf):
    p = global_positions(table(spark, sf, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"])
    b = rw.batch_rows(p, 8, drop_last=True)
    return b.select("batch", "batch_rows", F.md5(F.array_join("texts", "\x01")).alias("texts_md5"))


# --------------------------------------------------------------- E tokens

@register("e0_global_position",
          "SELECT doc_id, lang, row_number() OVER (ORDER BY lang, doc_id) - 1 AS pos, "
          "CAST(coalesce(sum(n_chars) OVER (ORDER BY lang, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum_before "
          "FROM documents")
def q_e0(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return global_positions(d, ["lang", "doc_id"], weight="n_chars").select("doc_id", "lang", "pos", "cum_before")


@register("e4_encode_words", _with("SELECT doc_id, split, " + _sql_arr("ids") + " AS ids FROM enc"))
def q_e4(spark, sf):
    return tk.encoded_docs(table(spark, sf, "documents"), SPLIT).select("doc_id", "split", _arr("ids").alias("ids"))


@register("e6_token_budget", _with(
    "SELECT split, doc_id, pos, cum_before FROM ord WHERE cum_before < "
    f"CASE split WHEN 'train' THEN {BUDGET['train']} WHEN 'val' THEN {BUDGET['val']} ELSE 0 END"))
def q_e6(spark, sf):
    e = tk.encoded_docs(table(spark, sf, "documents"), SPLIT).drop("text_x")
    return sh.token_budget(e, ["doc_id"], "ids", BUDGET).select("split", "doc_id", "pos", "cum_before")


_SHARD_WALK = f"""
walk(split, pos, shard, fill) AS (
  SELECT split, pos, 0, 2 * len(ids) FROM ord WHERE pos = 0
  UNION ALL
  SELECT o.split, o.pos,
         CASE WHEN w.fill > 0 AND w.fill + 2 * len(o.ids) > {SHARD_BYTES} THEN w.shard + 1 ELSE w.shard END,
         CASE WHEN w.fill > 0 AND w.fill + 2 * len(o.ids) > {SHARD_BYTES} THEN 2 * len(o.ids) ELSE w.fill + 2 * len(o.ids) END
  FROM walk w JOIN ord o ON o.split = w.split AND o.pos = w.pos + 1)
"""


@register("e7_assign_shards", _with(
    "SELECT o.split, o.doc_id, o.pos, CAST(w.shard AS INTEGER) AS shard FROM ord o JOIN walk w USING (split, pos)",
    _SHARD_WALK))
def q_e7(spark, sf):
    e = tk.encoded_docs(table(spark, sf, "documents"), SPLIT).select("split", "doc_id", (F.size("ids") * 2).alias("nbytes"))
    return sh.assign_shards(e, ["doc_id"], "nbytes", SHARD_BYTES).select("split", "doc_id", "pos", "shard")


@register("e9_split_stats", _with(
    "SELECT split, count(*) AS samples, CAST(sum(length(text_x) + 5) AS BIGINT) AS chars, "
    "CAST(sum(len(ids)) AS BIGINT) AS tokens, 'uint16' AS bin_dtype FROM enc GROUP BY split"))
def q_e9(spark, sf):
    e = tk.encoded_docs(table(spark, sf, "documents"), SPLIT)
    dtype, _ = sh.token_width(tk.HASH_VOCAB)
    return sh.split_stats(e, "text_x", "ids", tk.EOS_TOKEN).withColumn("bin_dtype", F.lit(dtype))


def _pad_ctes(max_len: int | None) -> str:
    ids = f"list_slice({_ids('text_x')}, 1, {max_len - 1}) || [3]" if max_len else "ids"
    return f"""
e64 AS (SELECT doc_id, split, {ids} AS ids FROM enc),
p64 AS (SELECT *, (row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1) // {PAD_BATCH} AS batch FROM e64),
w64 AS (SELECT *, max(len(ids)) OVER (PARTITION BY split, batch) AS width FROM p64),
pad AS (SELECT split, doc_id, CAST(batch AS BIGINT) AS batch,
               list_resize(list_slice(ids, 1, len(ids) - 1), width, 0) AS input_ids,
               list_resize(list_slice(ids, 2, len(ids)), width, -100) AS labels FROM w64)
"""


def _padded(spark, sf, max_len: int | None = None):
    """Padded batches of whole documents, or cut to ``max_len`` tokens (E10's own parameter)."""
    e = tk.encoded_docs(table(spark, sf, "documents"), SPLIT)
    if max_len:
        e = e.withColumn("ids", tk.encode_words("text_x", True, max_len))
    return pk.pad_stream(pk.stream_offsets(e.select("split", "doc_id", "ids"), ["doc_id"]), PAD_BATCH, tk.PAD_ID)


@register("e10_pad_batches", _with(
    f"SELECT split, doc_id, batch, {_sql_arr('input_ids')} AS input_ids, {_sql_arr('labels')} AS labels FROM pad",
    _pad_ctes(PAD_MAX_LEN)))
def q_e10(spark, sf):
    return _padded(spark, sf, PAD_MAX_LEN).select("split", "doc_id", "batch", _arr("input_ids").alias("input_ids"),
                                     _arr("labels").alias("labels"))


@register("e13_count_target_tokens", _with(
    "SELECT split, batch, target_tokens, CAST(sum(target_tokens) OVER (PARTITION BY split ORDER BY batch) AS BIGINT) AS cum_tokens "
    "FROM (SELECT split, batch, CAST(sum(len(list_filter(labels, lambda x: x <> -100))) AS BIGINT) AS target_tokens "
    "FROM pad GROUP BY split, batch) q", _pad_ctes(None)))
def q_e13(spark, sf):
    per = pk.count_target_tokens(_padded(spark, sf)).groupBy("split", "batch") \
            .agg(F.sum("target_tokens").cast("bigint").alias("target_tokens"))
    cum = global_positions(per, ["batch"], weight="target_tokens", group_cols=["split"])
    return cum.select("split", "batch", "target_tokens",
                      (F.col("cum_before") + F.col("target_tokens")).alias("cum_tokens"))


_TOKS = """
toks AS (SELECT split, cum_before + generate_subscripts(ids, 1) - 1 AS off, unnest(ids) AS tok FROM ord)
"""


@register("e11_pack_blocks", _with(
    f"SELECT split, block, {_sql_arr(f'list_slice(chunk, 1, {SEQ_LEN})')} AS input_ids, "
    f"{_sql_arr(f'list_slice(chunk, 2, {SEQ_LEN + 1})')} AS labels FROM "
    f"(SELECT split, CAST(off // {SEQ_LEN + 1} AS BIGINT) AS block, list(tok ORDER BY off) AS chunk "
    f" FROM toks GROUP BY split, off // {SEQ_LEN + 1}) q WHERE len(chunk) = {SEQ_LEN + 1}", _TOKS))
def q_e11(spark, sf):
    off = pk.stream_offsets(tk.encoded_docs(table(spark, sf, "documents"), SPLIT).drop("text_x"), ["doc_id"])
    b = pk.pack_blocks(off, SEQ_LEN)
    return b.select("split", "block", _arr("input_ids").alias("input_ids"), _arr("labels").alias("labels"))


_WINS = _TOKS.strip() + f""",
tot AS (SELECT split, max(off) + 1 AS n FROM toks GROUP BY split),
tw AS (SELECT t.split, t.off, t.tok,
              unnest(range(greatest(CAST(floor((t.off - {SEQ_LEN + 1}) / {STRIDE}) AS BIGINT) + 1, 0),
                           least(t.off // {STRIDE}, (n - {SEQ_LEN + 1}) // {STRIDE}) + 1)) AS window_id
       FROM toks t JOIN tot USING (split)),
wins AS (SELECT split, window_id, list(tok ORDER BY off) AS chunk FROM tw GROUP BY split, window_id)
"""


@register("e12_window_blocks", _with(
    f"SELECT split, window_id, {_sql_arr(f'list_slice(chunk, 1, {SEQ_LEN})')} AS input_ids, "
    f"{_sql_arr(f'list_slice(chunk, 2, {SEQ_LEN + 1})')} AS labels FROM wins", _WINS))
def q_e12(spark, sf):
    off = pk.stream_offsets(tk.encoded_docs(table(spark, sf, "documents"), SPLIT).drop("text_x"), ["doc_id"])
    w = pk.window_blocks(off, SEQ_LEN, STRIDE)
    return w.select("split", "window_id", _arr("input_ids").alias("input_ids"), _arr("labels").alias("labels"))


def _sql_permuted(x: str, n: str, seed: int) -> str:
    """The bijection of ``packing.permuted`` for DuckDB."""
    a = f"CAST(ceil(sqrt(CAST({n} AS DOUBLE))) AS BIGINT)"
    b = f"(({n} + {a} - 1) // {a})"
    mixed = "('0x' || substr(md5('{s}:' || j || ':' || ({half})), 1, 12))::BIGINT"
    left, right = f"(v // {b})", f"(v % {b})"
    one = (f"CASE WHEN j % 2 = 0 THEN (({left} + {mixed.format(s=seed, half=right)}) % {a}) * {b} + {right} "
           f"ELSE {left} * {b} + ({right} + {mixed.format(s=seed, half=left)}) % {b} END")
    network = "list_reduce([{v}] || range(" + str(pk.ROUNDS) + f"), lambda v, j: {one})"
    return (f"list_reduce([{network.format(v=x)}] || range({pk.WALK}), lambda w, i: CASE WHEN w < {n} THEN w ELSE {network.format(v='w')} END)")


@register("e14_epoch_sampler", _with(
    "SELECT split, window_id, sample_pos, CAST(sample_pos % 4 AS INTEGER) AS rank FROM (SELECT split, window_id, n, "
    f"{_sql_permuted('window_id', 'n', 43)} AS sample_pos FROM (SELECT split, n, unnest(range(n)) AS window_id FROM "
    f"(SELECT split, CAST((sum(len(ids)) - {SEQ_LEN + 1}) // {STRIDE} + 1 AS BIGINT) AS n FROM ord GROUP BY split) c) w) q WHERE sample_pos < (n // 4) * 4"))
def q_e14(spark, sf):
    d = tk.split_docs(table(spark, sf, "documents"), SPLIT)
    lengths = d.select("split", (F.size(words("text_x")) + 1).alias("n_tokens"))      # eos included
    counts = pk.window_counts(lengths, "n_tokens", SEQ_LEN, STRIDE)
    return pk.epoch_sampler(counts, 4, seed=42, epoch=1).select("split", "window_id", "sample_pos", "rank")


@register("a5_split_sources", f"""
SELECT CAST(doc_id AS VARCHAR) AS split_key, 'train' AS split, {_text_x('text')} AS text_x FROM documents WHERE {_text_x('text')} IS NOT NULL
UNION ALL SELECT CAST(item_id AS VARCHAR), 'val', {_text_x('text')} FROM benchmark WHERE {_text_x('text')} IS NOT NULL
UNION ALL SELECT conv_id || '/' || turn, 'test', {_text_x('text')} FROM conversations WHERE {_text_x('text')} IS NOT NULL""")
def q_a5(spark, sf):
    """Documents train, the benchmark is the named validation source, conversations the test source."""
    val = table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id")
    test = table(spark, sf, "conversations").withColumn("doc_id", F.concat_ws("/", "conv_id", "turn"))
    return split_sources(table(spark, sf, "documents"), val, test, SPLIT, ("text",), "doc_id")
