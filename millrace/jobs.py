"""Command-line jobs (``spark-submit -m millrace.jobs <job> ...`` or
``python -m millrace.jobs <job> ...``).

* ``dedup``: code or text rows -> canonical/tokens -> MinHash -> pairs ->
  cluster map -> snapshot; every stage written under ``<out>/stages/0N_name``
  and read back (A6), with a run manifest (A8).
* ``tokenize``: documents (and named validation and test sources) -> split -> BPE (reused when saved) -> ids -> token
  budget -> byte-sized shards (Parquet, optionally raw ``.bin``) -> split stats.
* ``samples``: token rows -> padded, packed or windowed training samples.
* ``diagnostics``: run log + runs (Parquet) -> one wide row per (run, layer)
  -> CSV (A9); ``--sigma`` adds the sigma and entropy bounds.
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import functions as F

from millrace.config import BPEConfig, LSHConfig, MinHashConfig, SnapshotConfig, SplitConfig
from millrace.operators import bpe, packing, runlog, shards
from millrace.operators.canon import canonicalize
from millrace.operators.components import cluster_map
from millrace.operators.lsh import band_keys, candidate_pairs
from millrace.operators.minhash import apply_minhash
from millrace.operators.snapshot import cluster_snapshot
from millrace.operators.split import check_split_plan, split_path, split_sources
from millrace.session import build_session
from millrace.sources import corpus as cs
from millrace.sources import tokenshards as ts


def _read(spark, path: str, fmt: str, schema: str | None):
    if fmt == "jsonl":
        df = cs.read_jsonl_corpus(spark, path, schema or "id string, text string")
    else:
        df = cs.read_parquet_corpus(spark, path)
    if "id" not in df.columns and "doc_id" in df.columns:
        df = df.withColumn("id", F.col("doc_id"))
    return df.withColumn("id", F.col("id").cast("string")) if "id" in df.columns else df


def run_dedup(spark, args) -> dict:
    t0, stages = time.time(), []
    out = args.out.rstrip("/")
    rows = _read(spark, args.input, args.format, args.schema)
    if args.limit:
        rows = rows.orderBy("id").limit(args.limit)            # debug cap, applied once (Q6)
    if "code_ref" in rows.columns:                             # code rows: AST node types
        canon, m = cs.observed_write(canonicalize(rows), f"{out}/stages/01_canonical", "canonical")
        tokens, ok = "node_types", "parse_ok"
    else:                                                      # text rows: lower-cased words
        from millrace.functions.text import words
        rows = rows.withColumn("code_ref", F.col("text"))      # the text competes as the "code" (longest wins)
        canon, m = cs.observed_write(rows.withColumn("tokens", words("text")), f"{out}/stages/01_tokens", "tokens")
        tokens, ok = "tokens", None
    stages.append(m)
    mh = MinHashConfig(num_perm=args.num_perm)
    lsh = LSHConfig(k=args.num_perm, b=args.bands)
    sigs, m = cs.observed_write(apply_minhash(canon.select("id", tokens, *([ok] if ok else [])), tokens, mh, ok),
                                f"{out}/stages/02_minhash", "minhash")
    stages.append(m)
    pairs, m = cs.observed_write(candidate_pairs(band_keys(sigs, lsh)), f"{out}/stages/03_pairs", "pairs")
    stages.append(m)
    cmap, m = cs.observed_write(cluster_map(pairs), f"{out}/stages/04_cluster_map", "cluster_map")
    stages.append(m)
    snap, m = cs.observed_write(cluster_snapshot(canon, cmap, SnapshotConfig()), f"{out}/stages/05_snapshot", "snapshot")
    stages.append(m)
    cs.write_manifest(spark, f"{out}/manifest", args.run_id, "finished", t0, stages, {"snapshot": f"{out}/stages/05_snapshot"})
    return {"stages": stages}


def run_tokenize(spark, args) -> dict:
    t0, stages = time.time(), []
    out = args.out.rstrip("/")
    cfg = BPEConfig(vocab_size=args.vocab_size, min_frequency=args.min_frequency)
    split = SplitConfig(args.val_fraction, args.seed)
    paths = {"train": args.input, **dict(x.split("=", 1) for x in args.split)}
    val, test = (_read(spark, split_path(paths, name), args.format, args.schema) if name else None
                 for name in (args.val_split, args.test_split))
    check_split_plan(split, val is not None, args.val_tokens)
    docs = _read(spark, args.input, args.format, args.schema)
    key = next((c for c in ("id", "uuid", "guid", "doc_id") if c in docs.columns), None)
    # row_key is assigned once and fixed by the written stage: it is the file
    # order the sequential writer would follow, and unique even when the
    # split key falls back to the text.
    rows = split_sources(docs, val, test, split, tuple(args.text_fields), key) \
        .withColumn("row_key", F.monotonically_increasing_id())
    texts, m = cs.observed_write(rows, f"{out}/stages/01_split", "split")
    stages.append(m)
    train = texts.where(F.col("split") == "train")
    model = bpe.load_or_train(spark, f"{out}/tokenizer", bpe.pretoken_counts(train, "text_x", cfg), cfg)
    enc = bpe.encode(texts, model, cfg, "text_x", ("row_key",), append_eos=True)
    enc = enc.join(texts.select("row_key", "split_key", "split", "text_x"), "row_key")
    targets = {k: v for k, v in (("train", args.train_tokens), ("val", args.val_tokens), ("test", args.test_tokens))
               if v is not None}
    kept = enc.where(~F.coalesce(F.col("split").isin(*targets), F.lit(False))) if targets else enc   # no target: whole split
    if targets:
        kept = kept.unionByName(shards.token_budget(enc.where(F.col("split").isin(*targets)), ["row_key"], "ids", targets)
                                      .drop("pos", "cum_before"))
    dtype, width = shards.token_width(args.vocab_size)
    placed = shards.assign_shards(kept.withColumn("nbytes", F.size("ids") * width), ["row_key"], "nbytes",
                                  args.shard_bytes)
    sharded = placed.select("split", "shard", "pos", F.col("split_key").alias("doc_id"), F.col("ids").alias("tokens"))
    ts.write_parquet_shards(sharded, f"{out}/shards", dtype)
    if args.raw_bin:
        ts.write_raw_shards(sharded, f"{out}/bin", dtype)
    stats = shards.split_stats(kept, "text_x", "ids", cfg.eos_token).withColumn("bin_dtype", F.lit(dtype))
    stats.coalesce(1).write.mode("overwrite").json(f"{out}/split_stats")
    cs.write_manifest(spark, f"{out}/manifest", args.run_id, "finished", t0, stages,
                      {"shards": f"{out}/shards", "tokenizer": f"{out}/tokenizer"},
                      {r["split"]: r.asDict() for r in stats.collect()})    # one row per split
    return {"stages": stages}


def run_samples(spark, args) -> dict:
    """Token rows (the ``shards`` of the tokenize job) -> padded, packed or windowed samples."""
    t0, out = time.time(), args.out.rstrip("/")
    rows = spark.read.parquet(args.input).select("split", "shard", "pos", F.col("tokens").alias("ids"))
    if args.mode == "padded":
        if args.max_len:
            rows = rows.withColumn("ids", F.slice("ids", 1, args.max_len))
        placed = packing.stream_offsets(rows.withColumnRenamed("pos", "doc_pos"), ["shard", "doc_pos"])
        table = packing.pad_stream(placed, args.batch_size, args.pad_id).select("split", "batch", "pos", "input_ids", "labels")
    else:
        offsets = packing.stream_offsets(rows.withColumnRenamed("pos", "doc_pos"), ["shard", "doc_pos"])
        table = packing.pack_blocks(offsets, args.seq_len) if args.mode == "packed" else packing.window_blocks(offsets, args.seq_len, args.stride)
    table, m = cs.observed_write(table, f"{out}/{args.mode}", args.mode)
    per = packing.count_target_tokens(table).groupBy("split").agg(F.count(F.lit(1)).alias("samples"), F.sum("target_tokens").alias("target_tokens"))
    cs.write_manifest(spark, f"{out}/manifest", args.run_id, "finished", t0, [m], {args.mode: f"{out}/{args.mode}"},
                      {r["split"]: r.asDict() for r in per.collect()})    # one row per split
    return {"stages": [m]}


def run_diagnostics(spark, args) -> dict:
    log = spark.read.parquet(args.run_log)
    runs = spark.read.parquet(args.runs)
    wide = runlog.pivot_metrics(runlog.diagnostics_table(runs, log, args.all_steps, args.change_tag_prefix,
                                                         args.change_summary_key))
    if args.sigma:
        wide = runlog.with_entropy(runlog.sigma_bounds(wide))
    cs.write_table(wide, args.out, ["change", "layer", "step"])
    return {"out": args.out}


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="millrace.jobs")
    sub = ap.add_subparsers(dest="job", required=True)
    for name in ("dedup", "tokenize"):
        p = sub.add_parser(name)
        p.add_argument("--input", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--format", choices=["parquet", "jsonl"], default="parquet")
        p.add_argument("--schema", default=None)
        p.add_argument("--run-id", default=f"{name}-{int(time.time())}")
    d = sub.choices["dedup"]
    d.add_argument("--limit", type=int, default=None)
    d.add_argument("--num-perm", type=int, default=128)
    d.add_argument("--bands", type=int, default=32)
    t = sub.choices["tokenize"]
    t.add_argument("--text-fields", nargs="+", default=["text"])
    t.add_argument("--vocab-size", type=int, default=16000)
    t.add_argument("--min-frequency", type=int, default=2)
    t.add_argument("--val-fraction", type=float, default=0.01)
    t.add_argument("--seed", type=int, default=42)
    t.add_argument("--train-tokens", type=int, default=None)    # no target: every document is kept
    t.add_argument("--val-tokens", type=int, default=None)
    t.add_argument("--test-tokens", type=int, default=None)
    t.add_argument("--split", action="append", default=[], metavar="NAME=PATH")
    t.add_argument("--val-split", default=None)
    t.add_argument("--test-split", default=None)
    t.add_argument("--shard-bytes", type=int, default=268_435_456)
    t.add_argument("--raw-bin", action="store_true")
    p = sub.add_parser("samples")
    p.add_argument("--input", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--mode", choices=["padded", "packed", "windowed"], default="packed")
    p.add_argument("--seq-len", type=int, default=512)
    p.add_argument("--stride", type=int, default=None)
    p.add_argument("--batch-size", type=int, default=32)
    p.add_argument("--max-len", type=int, default=None)
    p.add_argument("--pad-id", type=int, default=0)
    p.add_argument("--run-id", default=f"samples-{int(time.time())}")
    g = sub.add_parser("diagnostics")
    g.add_argument("--run-log", required=True)
    g.add_argument("--runs", required=True)
    g.add_argument("--out", required=True)
    g.add_argument("--all-steps", action="store_true")
    g.add_argument("--sigma", action="store_true")
    g.add_argument("--change-tag-prefix", default="qk-init-m-")
    g.add_argument("--change-summary-key", default="config/qk_gain_init")
    args = ap.parse_args(argv)
    spark = build_session()
    result = {"dedup": run_dedup, "tokenize": run_tokenize, "samples": run_samples, "diagnostics": run_diagnostics}[args.job](spark, args)
    print(json.dumps(result, default=str))


if __name__ == "__main__":
    main()
