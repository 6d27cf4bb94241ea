"""Run-log analytics over tables instead of a hosted tracker.

Inputs: ``run_log(run_id, metrics MAP<STRING,DOUBLE>)`` with one row per
logged history row, and ``runs(run_id, run_name, state, tags ARRAY<STRING>,
summary MAP<STRING,STRING>)``. Everything is column expressions, joins and
aggregates; per-run running values use the E0 scan, so one huge run is
spread over range partitions instead of one window task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.position import global_positions

# The diagnostics key pattern of the logged history.
ATTN_KEY_RE = r"^attention_diagnostics/layer_(\d+)/(.+)$"

# Metric keys renamed into namespaces before logging, in the
# reference's order (source key, logged key).
RENAME_KEYS = (
    ("optimizer/lr", "primary/lr"),
    ("optimizer/attention_lr", "primary/attention_lr"),
    ("diagnostics/grad_norm", "primary/grad_norm"),
    ("diagnostics/update_to_param_norm", "primary/update_to_param_norm"),
    ("diagnostics/final_hidden_l2", "primary/final_hidden_l2"),
    ("diagnostics/logit_l2", "primary/logit_l2"),
    ("diagnostics/mean_max_softmax_prob", "primary/mean_max_softmax_prob"),
    ("diagnostics/has_nan_or_inf_loss", "primary/has_nan_or_inf_loss"),
    ("diagnostics/has_nan_or_inf_grad", "primary/has_nan_or_inf_grad"),
    ("diagnostics/has_nan_or_inf", "primary/has_nan_or_inf"),
    ("timing/elapsed_since_start_sec", "train/elapsed_sec"),
    ("diagnostics/param_norm", "secondary/param_norm"),
    ("diagnostics/update_norm", "secondary/update_norm"),
    ("diagnostics/max_logit", "secondary/max_logit"),
    ("diagnostics/min_logit", "secondary/min_logit"),
    ("diagnostics/logsumexp_logits", "secondary/logsumexp_logits"),
    ("diagnostics/attn_logit_max_layer0", "secondary/attn_logit_max_layer0"),
    ("diagnostics/attn_logit_max_layer0_log", "secondary/attn_logit_max_layer0_log"),
    ("sharpness/lambda_max_global", "sharpness/lambda_max_global"),
    ("sharpness/lambda_max_attention_block", "sharpness/lambda_max_attention_block"),
    ("sharpness/lambda_max_mlp_block", "sharpness/lambda_max_mlp_block"),
    ("sharpness/update_norm_times_lambda_max", "sharpness/update_norm_times_lambda_max"),
)
# Prefixes logged unchanged.
PASS_PREFIXES = ("optimizer_inspect/", "attention_diagnostics/", "step_zero/")
# The resource metrics sampled every n steps.
RESOURCE_METRICS = ("gpu/memory_reserved_gb", "throughput/tokens_per_sec", "timing/elapsed_since_start_sec")
# Columns the sigma bound needs.
SIGMA_REQUIRED = ("attention_logit_multiplier", "head_dim", "xxt_norm_2_mean", "xxt_norm_2_max", "wk_wqT_norm_2")
LEADING = ("change", "layer", "step", "run_name", "run_id", "state")
# The identity of a log row under all steps, and metric names that may become columns.
LOG_ROW, MAX_METRICS = "log_row", 2_000


def finite_or_null(v: Column) -> Column:
    """NaN and +-Inf become null."""
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(v)


def step_of(metrics: Column) -> Column:
    """``_step``, else ``train/step``."""
    return F.coalesce(metrics.getItem("_step"), metrics.getItem("train/step")).cast("bigint")


def with_log_position(run_log: DataFrame) -> DataFrame:
    """Adds ``log_pos``, the place of a row in the log; a log that carries a
    ``log_pos`` column keeps it. Otherwise rows are placed by step, rows
    without a step before all others, and rows of one step by a hash of their
    metrics, so that exactly one row is the last."""
    if "log_pos" in run_log.columns:
        return run_log
    step = step_of(F.col("metrics"))
    return run_log.withColumn("log_pos", F.struct(step.alias("step"), F.xxhash64(F.to_json("metrics")).alias("h")))


def unpivot_diagnostics(run_log: DataFrame, keep_position: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """G1: ``(run_id, step, layer, metric, value)`` from the diagnostics keys
    (and ``log_pos``, see ``with_log_position``, when asked for; and the log's
    columns ``keep``)."""
    pos = (["log_pos"] if keep_position else []) + list(keep)
    e = (with_log_position(run_log) if keep_position else run_log).select(
        "run_id", step_of(F.col("metrics")).alias("step"), *pos, F.explode("metrics").alias("key", "value"))
    e = e.where(F.col("key").rlike(ATTN_KEY_RE))
    return e.select("run_id", "step", *pos,
                    F.regexp_extract("key", ATTN_KEY_RE, 1).cast("int").alias("layer"),
                    F.regexp_extract("key", ATTN_KEY_RE, 2).alias("metric"),
                    finite_or_null(F.col("value")).alias("value"))


def latest_per_layer(long: DataFrame) -> DataFrame:
    """Per (run, layer) the metrics of the last log row that has the layer
    (the row wins whole; values from earlier rows are not merged in).
    ``long`` carries ``log_pos``; the result does not."""
    last = long.groupBy("run_id", "layer").agg(F.max("log_pos").alias("_last"))
    return (long.join(last, ["run_id", "layer"]).where(F.col("log_pos") == F.col("_last"))
                .select("run_id", "step", "layer", "metric", "value"))


_FLOAT_TEXT = r"^[-+]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$|^[-+]?[0-9]+[eE][-+]?[0-9]+$"


def format_g(x: Column) -> Column:
    """Python ``"%g" % x``: Java ``%g`` (same precision and switch point)
    with trailing zeros of the mantissa removed."""
    s = F.format_string("%g", x)
    s = F.regexp_replace(s, r"(\.[0-9]*?)0+(e|$)", "$1$2")
    return F.regexp_replace(s, r"\.(e|$)", "$1")


def change_label(runs: DataFrame, prefix: str = "qk-init-m-", summary_key: str | None = "config/qk_gain_init") -> DataFrame:
    """Adds ``change``: a float summary value -> prefix + ``%g``; another
    summary value -> its text; else the shortest tag with the prefix (first
    of equal length); else the run name; else the run id."""
    cands = []
    if summary_key:
        v = F.col("summary").getItem(summary_key)
        cands.append(F.when(v.rlike(_FLOAT_TEXT), F.concat(F.lit(prefix), format_g(v.cast("double")))).otherwise(v))
    tagged = F.filter(F.transform(F.coalesce(F.col("tags"), F.array().cast("array<string>")),
                                  lambda t, i: F.struct(F.length(t).alias("n"), i.alias("i"), t.alias("t"))),
                      lambda s: s["t"].startswith(prefix))
    cands.append(F.array_min(tagged)["t"])
    cands += [F.col("run_name"), F.col("run_id")]
    return runs.withColumn("change", F.coalesce(*cands))


def summary_fallback(runs: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Runs without any diagnostics row in their history contribute their
    summary diagnostics as ``(run_id, step, layer, metric, value)``.
    ``diagnostics``: the unpivoted history (G1)."""
    orphans = runs.join(diagnostics.select("run_id").distinct(), "run_id", "left_anti")
    e = orphans.select("run_id", F.col("summary").getItem("_step").cast("bigint").alias("step"),
                       F.explode("summary").alias("key", "value"))
    e = e.where(F.col("key").rlike(ATTN_KEY_RE))
    return e.select("run_id", "step",
                    F.regexp_extract("key", ATTN_KEY_RE, 1).cast("int").alias("layer"),
                    F.regexp_extract("key", ATTN_KEY_RE, 2).alias("metric"),
                    finite_or_null(F.col("value").cast("double")).alias("value"))


def diagnostics_table(runs: DataFrame, run_log: DataFrame, all_steps: bool = False,
                      prefix: str = "qk-init-m-", summary_key: str | None = "config/qk_gain_init") -> DataFrame:
    """G1-G6 combined: long rows ``(change, layer, step, run_name, run_id,
    state, metric, value)`` from history, or from the summary for runs
    without history. With ``all_steps`` the rows also carry ``log_row``, the
    identity of the log row they come from: log rows of one step stay apart,
    equal ones too."""
    if all_steps:
        hist = unpivot_diagnostics(run_log.withColumn(LOG_ROW, F.monotonically_increasing_id()), keep=[LOG_ROW])
        rows = hist.unionByName(summary_fallback(runs, hist), allowMissingColumns=True)
    else:
        hist = unpivot_diagnostics(run_log, keep_position=True)
        rows = latest_per_layer(hist).unionByName(summary_fallback(runs, hist))
    labelled = change_label(runs, prefix, summary_key).select("run_id", "run_name", "state", "change")
    return rows.join(labelled, "run_id")


def pivot_metrics(long: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """One column per metric (sorted), leading columns first, rows
    sorted by change, layer, step. With ``log_row`` (all steps) each log row
    and layer is a row of its own. Pass ``metrics`` to skip the job that lists
    the names; more than ``MAX_METRICS`` of them are an error, since each
    becomes a column."""
    if metrics is None:
        metrics = [r[0] for r in long.select("metric").distinct().limit(MAX_METRICS + 1).collect()]
    metrics = sorted(m for m in metrics if m not in LEADING)
    if len(metrics) > MAX_METRICS:
        raise ValueError(f"more than {MAX_METRICS} metric names cannot become columns; pass the ones to keep")
    row = [LOG_ROW] if LOG_ROW in long.columns else []
    wide = long.groupBy(*LEADING, *row).pivot("metric", metrics).agg(F.first("value", ignorenulls=True))
    return wide.orderBy("change", "layer", "step", *row).select(*LEADING, *metrics)


def best_val_flags(steps: DataFrame, run_col: str = "run_id", step_col: str = "step",
                   loss_col: str = "val_loss") -> DataFrame:
    """``is_best`` = the loss is strictly below every earlier loss of the run."""
    v = steps.where(F.col(loss_col).isNotNull())
    r = global_positions(v, [step_col], weight=loss_col, group_cols=[run_col],
                         pos_col="_vpos", before_col="best_before", agg="min")
    return r.withColumn("is_best", F.col("best_before").isNull() | (F.col(loss_col) < F.col("best_before"))) \
            .drop("_vpos")


def run_rollup(steps: DataFrame, token_target: int) -> DataFrame:
    """G8 per run: best val loss, mean eval loss (sum / max(count, 1)), last
    step, tokens seen, first step whose running tokens reach the target, and
    a flag for any non-finite loss or gradient norm."""
    cum = global_positions(steps, ["step"], weight="tokens", group_cols=["run_id"], pos_col="_p")
    cum = cum.withColumn("tokens_through", F.col("cum_before") + F.coalesce(F.col("tokens"), F.lit(0)))

    def bad(c):
        return F.col(c).isNotNull() & finite_or_null(F.col(c)).isNull()

    return cum.groupBy("run_id").agg(
        F.min("val_loss").alias("best_val_loss"),
        (F.coalesce(F.sum("val_loss"), F.lit(0.0)) / F.greatest(F.count("val_loss"), F.lit(1))).alias("mean_eval_loss"),
        F.max("step").alias("last_step"),
        F.sum("tokens").cast("bigint").alias("tokens_seen"),
        F.min(F.when(F.col("tokens_through") >= token_target, F.col("step"))).alias("step_at_target"),
        F.bool_or(bad("train_loss") | bad("grad_norm")).alias("had_nan"),
    )


def stage_throughput(stages: DataFrame) -> DataFrame:
    """Rows / seconds when both are known and seconds > 0."""
    ok = F.col("rows_processed").isNotNull() & (F.col("wall_time_sec") > 0)
    return stages.withColumn("throughput_rows_per_sec",
                             F.when(ok, F.col("rows_processed") / F.col("wall_time_sec")))


def stage_totals(stages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stage count, total seconds, total known rows."""
    return stages.groupBy(*by).agg(F.count(F.lit(1)).alias("stages"),
                                   F.sum("wall_time_sec").alias("total_time_sec"),
                                   F.sum("rows_processed").cast("bigint").alias("total_rows"))


def rename_metrics(long: DataFrame, key_col: str = "key", value_col: str = "value") -> DataFrame:
    """Fixed key renames plus pass-through prefixes; null values dropped.
    The key map is a fixed 22-row table, so broadcasting it is bounded."""
    spark = long.sparkSession
    kmap = spark.createDataFrame(list(RENAME_KEYS), "src string, dst string")
    v = long.where(F.col(value_col).isNotNull())
    renamed = v.join(F.broadcast(kmap), v[key_col] == kmap["src"]).select(
        *[c for c in long.columns if c != key_col], F.col("dst").alias(key_col))
    passing = F.lit(False)
    for p in PASS_PREFIXES:
        passing = passing | F.col(key_col).startswith(p)
    return renamed.unionByName(v.where(passing).select(*[c for c in long.columns if c != key_col], key_col))


def sample_every(steps: DataFrame, n: int, step_col: str = "step") -> DataFrame:
    """Rows at steps divisible by ``n`` (the resource sampler)."""
    return steps.where(F.pmod(F.col(step_col), F.lit(n)) == 0)


def sigma_bounds(diag: DataFrame) -> DataFrame:
    """``scale = mult / sqrt(head_dim)``; sigma bounds from the norms;
    deltas to the logged bounds when those columns exist."""
    missing = [c for c in SIGMA_REQUIRED if c not in diag.columns]
    if missing:
        raise ValueError("missing required columns: " + ", ".join(missing))
    scale = F.col("attention_logit_multiplier") / F.sqrt(F.col("head_dim").cast("double"))
    out = (diag.withColumn("sigma_bound_mean", scale * F.col("xxt_norm_2_mean") * F.col("wk_wqT_norm_2"))
               .withColumn("sigma_bound_max", scale * F.col("xxt_norm_2_max") * F.col("wk_wqT_norm_2")))
    if "score_norm_bound_mean" in diag.columns:
        out = out.withColumn("sigma_bound_mean_logged_delta", F.col("sigma_bound_mean") - F.col("score_norm_bound_mean"))
    if "score_norm_bound_max" in diag.columns:
        out = out.withColumn("sigma_bound_max_logged_delta", F.col("sigma_bound_max") - F.col("score_norm_bound_max"))
    return out


def entropy_lower_bound(sigma: Column, n: Column) -> tuple[Column, Column]:
    """``p = e^s / (e^s + n - 1)`` (s capped at 700), ``q = (1-p)/(n-1)``,
    ``H = -p ln p - (n-1) q ln q`` with logs floored at 1e-300; returns
    ``(H, H / ln n)``."""
    n = n.cast("double")
    e = F.exp(F.least(sigma.cast("double"), F.lit(700.0)))
    p = e / (e + n - 1.0)
    q = (1.0 - p) / (n - 1.0)

    def clip(x):
        return F.least(F.greatest(x, F.lit(1e-300)), F.lit(1.0))

    h = -(p * F.log(clip(p))) - (n - 1.0) * q * F.log(clip(q))
    return h, h / F.log(n)


def with_entropy(diag_sigma: DataFrame) -> DataFrame:
    out = diag_sigma
    if "seq_len" in diag_sigma.columns:
        for src, dst in (("sigma_bound_mean", "entropy_lower_bound_from_sigma_mean"),
                         ("sigma_bound_max", "entropy_lower_bound_from_sigma_max")):
            h, hn = entropy_lower_bound(F.col(src), F.col("seq_len"))
            out = out.withColumn(dst, h).withColumn(dst + "_normalized", hn)
    return out


def lr_sweep_summary(runs: DataFrame) -> DataFrame:
    """Sweep runs (names starting ``lr-sweep-``): lr from the summary
    else from ``-lr(.+)$`` in the name, model from ``lr-sweep-(.+)-lr`` (else
    the name), ``failed`` default false; sorted by dim, layers, lr."""
    s = F.col("summary")
    name = F.coalesce(F.col("run_name"), F.lit(""))
    lr_name = F.regexp_extract(name, r"-lr(.+)$", 1)
    model = F.regexp_extract(name, r"lr-sweep-(.+)-lr", 1)
    out = runs.where(name.startswith("lr-sweep-")).select(
        name.alias("run_name"),
        F.when(model != "", model).otherwise(name).alias("model"),
        s.getItem("config/num_layers").cast("int").alias("num_layers"),
        s.getItem("config/model_dim").cast("int").alias("model_dim"),
        F.coalesce(s.getItem("config/lr").cast("double"),
                   F.when(lr_name != "", lr_name.cast("double"))).alias("lr"),
        "state",
        s.getItem("best_val_loss").cast("double").alias("best_val_loss"),
        s.getItem("last_train_loss").cast("double").alias("last_train_loss"),
        F.coalesce(s.getItem("failed").cast("boolean"), F.lit(False)).alias("failed"),
    )
    return out.orderBy("model_dim", "num_layers", "lr")
