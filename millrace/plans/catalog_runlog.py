"""Catalog entries for G* (run-log analytics) over ``events`` and ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import runlog as rl
from millrace.plans import runlog as b
from millrace.plans.catalog import register, table

TOKEN_TARGET = 50_000
METRICS = ["click", "error", "purchase", "signup", "view"]

EV = """
ev AS (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
              'run-' || CAST(user_id AS VARCHAR) AS run_id FROM events),
hist AS (SELECT run_id, event_id AS step, CAST(k % 8 AS INTEGER) AS layer, event_type AS metric,
                CASE WHEN isnan(value) OR isinf(value) THEN NULL ELSE value END AS value
         FROM ev WHERE user_id % 10 <> 0),
latest AS (SELECT h.* FROM hist h JOIN (SELECT run_id, layer, max(step) AS step FROM hist GROUP BY run_id, layer) m
           USING (run_id, layer, step)),
fallback AS (SELECT o.run_id, s.step, CAST(o.k % 8 AS INTEGER) AS layer, o.event_type AS metric,
                    arg_max(o.value, o.event_id) AS value
             FROM ev o JOIN (SELECT run_id, max(event_id) AS step FROM ev GROUP BY run_id) s USING (run_id)
             WHERE o.user_id % 10 = 0 GROUP BY o.run_id, s.step, o.k % 8, o.event_type),
runs AS (SELECT run_id, user_id,
           CASE WHEN user_id % 11 = 0 THEN NULL
                WHEN user_id % 3 = 0 THEN 'lr-sweep-' || (['2p4M', '9p4M', '19M', '42M'])[user_id % 4 + 1]
                                          || '-lr0.00' || CAST(user_id % 9 + 1 AS VARCHAR)
                ELSE 'trial-' || CAST(user_id AS VARCHAR) END AS run_name,
           CASE WHEN user_id % 7 = 0 THEN 'failed' ELSE 'finished' END AS state
         FROM ev GROUP BY run_id, user_id),
labels AS (SELECT run_id, run_name, state,
             CASE WHEN user_id % 8 = 0 THEN 'qk-init-m-' || printf('%g', user_id / 8.0)
                  WHEN user_id % 8 = 4 THEN CAST(user_id % 7 AS VARCHAR)
                  WHEN user_id % 6 = 0 THEN 'qk-init-m-9'
                  WHEN user_id % 2 = 0 THEN 'qk-init-m-' || CAST(user_id % 5 AS VARCHAR)
                  ELSE coalesce(run_name, run_id) END AS change
           FROM runs),
st AS (SELECT run_id, event_id AS step,
              CASE WHEN event_type = 'view' THEN value END AS train_loss,
              CASE WHEN event_type = 'purchase' THEN value END AS val_loss,
              CAST(floor(value * 100) AS BIGINT) AS tokens,
              value / 4 AS gpu_memory_reserved_gb, value * 1000 AS tokens_per_sec, event_id * 0.5 AS elapsed_sec
       FROM ev)
"""


def _with(body: str) -> str:
    return "WITH " + EV.strip() + "\n" + body


def _tabs(spark, sf):
    ev = table(spark, sf, "events")
    return b.run_log(ev), b.runs(ev)


@register("g1_unpivot_diagnostics", _with("SELECT run_id, step, layer, metric, value FROM hist"))
def q_g1(spark, sf):
    return rl.unpivot_diagnostics(b.run_log(table(spark, sf, "events")))


@register("g3_change_label", _with("SELECT run_id, change FROM labels"))
def q_g3(spark, sf):
    return rl.change_label(b.runs(table(spark, sf, "events"))).select("run_id", "change")


@register("g4_latest_per_layer", _with("SELECT run_id, layer, step, metric, value FROM latest"))
def q_g4(spark, sf):
    return rl.latest_per_layer(rl.unpivot_diagnostics(b.run_log(table(spark, sf, "events")), keep_position=True)) \
             .select("run_id", "layer", "step", "metric", "value")


@register("g6_summary_fallback", _with("SELECT run_id, step, layer, metric, value FROM fallback"))
def q_g6(spark, sf):
    log, runs = _tabs(spark, sf)
    return rl.summary_fallback(runs, rl.unpivot_diagnostics(log))


_PIVOT_COLS = ", ".join(f"max(CASE WHEN metric = '{m}' THEN value END) AS {m}" for m in METRICS)


@register("g7_pivot_metrics", _with(
    f"SELECT l.change, d.layer, d.step, l.run_name, d.run_id, l.state, {_PIVOT_COLS} "
    "FROM (SELECT * FROM latest UNION ALL SELECT * FROM fallback) d JOIN labels l USING (run_id) "
    "GROUP BY l.change, d.layer, d.step, l.run_name, d.run_id, l.state"))
def q_g7(spark, sf):
    log, runs = _tabs(spark, sf)
    return rl.pivot_metrics(rl.diagnostics_table(runs, log), METRICS)


@register("g7_all_steps", _with(
    f"SELECT l.change, d.layer, d.step, l.run_name, d.run_id, l.state, {_PIVOT_COLS} "
    "FROM (SELECT * FROM hist UNION ALL SELECT * FROM fallback) d JOIN labels l USING (run_id) "
    "GROUP BY l.change, d.layer, d.step, l.run_name, d.run_id, l.state"))
def q_g7a(spark, sf):
    log, runs = _tabs(spark, sf)
    return rl.pivot_metrics(rl.diagnostics_table(runs, log, all_steps=True))


@register("g8_run_rollup", _with(
    "SELECT run_id, min(val_loss) AS best_val_loss, "
    "round(coalesce(sum(val_loss), 0) / greatest(count(val_loss), 1), 9) AS mean_eval_loss, "
    "max(step) AS last_step, CAST(sum(tokens) AS BIGINT) AS tokens_seen, "
    f"min(CASE WHEN cum >= {TOKEN_TARGET} THEN step END) AS step_at_target, "
    "bool_or(train_loss IS NOT NULL AND (isnan(train_loss) OR isinf(train_loss))) AS had_nan "
    "FROM (SELECT *, sum(tokens) OVER (PARTITION BY run_id ORDER BY step) AS cum FROM st) q GROUP BY run_id"))
def q_g8(spark, sf):
    s = b.steps(table(spark, sf, "events"))
    return rl.run_rollup(s, TOKEN_TARGET).withColumn("mean_eval_loss", F.round("mean_eval_loss", 9))


@register("w5_best_val_flags", _with(
    "SELECT run_id, step, val_loss, (prev IS NULL OR val_loss < prev) AS is_best FROM "
    "(SELECT run_id, step, val_loss, min(val_loss) OVER (PARTITION BY run_id ORDER BY step "
    " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM st WHERE val_loss IS NOT NULL) q"))
def q_w5(spark, sf):
    s = b.steps(table(spark, sf, "events"))
    return rl.best_val_flags(s).select("run_id", "step", "val_loss", "is_best")


_STAGES = ("SELECT event_id AS stage_id, event_type AS stage, value AS wall_time_sec, "
           "CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(k AS BIGINT) * 100 END AS rows_processed FROM ev")


@register("g9_stage_throughput", _with(
    "SELECT *, CASE WHEN rows_processed IS NOT NULL AND wall_time_sec > 0 THEN rows_processed / wall_time_sec END "
    f"AS throughput_rows_per_sec FROM ({_STAGES}) s"))
def q_g9(spark, sf):
    return rl.stage_throughput(b.stage_log(table(spark, sf, "events")))


@register("g9_stage_totals", _with(
    "SELECT stage, count(*) AS stages, round(sum(wall_time_sec), 6) AS total_time_sec, "
    f"CAST(sum(rows_processed) AS BIGINT) AS total_rows FROM ({_STAGES}) s GROUP BY stage"))
def q_g9t(spark, sf):
    t = rl.stage_totals(b.stage_log(table(spark, sf, "events")), ["stage"])
    return t.withColumn("total_time_sec", F.round("total_time_sec", 6))


_RENAMES = ", ".join(f"('{s}', '{d}')" for s, d in rl.RENAME_KEYS)


@register("g10_rename_metrics", _with(
    "SELECT run_id, step, coalesce(km.dst, m.key) AS key, m.value FROM (SELECT run_id, event_id AS step, "
    "CASE event_type WHEN 'view' THEN 'optimizer/lr' WHEN 'click' THEN 'diagnostics/grad_norm' "
    "WHEN 'signup' THEN 'timing/elapsed_since_start_sec' "
    "WHEN 'purchase' THEN 'attention_diagnostics/layer_' || CAST(k % 8 AS VARCHAR) || '/purchase' "
    "ELSE 'diagnostics/custom_error' END AS key, CASE WHEN k % 13 = 0 THEN NULL ELSE value END AS value FROM ev) m "
    f"LEFT JOIN (VALUES {_RENAMES}) km(src, dst) ON m.key = km.src "
    "WHERE m.value IS NOT NULL AND (km.dst IS NOT NULL OR m.key LIKE 'optimizer_inspect/%' "
    "OR m.key LIKE 'attention_diagnostics/%' OR m.key LIKE 'step_zero/%')"))
def q_g10(spark, sf):
    return rl.rename_metrics(b.metric_log(table(spark, sf, "events")))


@register("g11_sample_every", _with(
    "SELECT run_id, step, gpu_memory_reserved_gb, tokens_per_sec, elapsed_sec FROM st WHERE step % 10 = 0"))
def q_g11(spark, sf):
    s = b.steps(table(spark, sf, "events"))
    return rl.sample_every(s, 10).select("run_id", "step", "gpu_memory_reserved_gb", "tokens_per_sec", "elapsed_sec")


_DIAG = ("SELECT p_brand AS change, CAST(p_partkey % 8 AS INTEGER) AS layer, p_partkey AS step, "
         "1.0 + (p_partkey % 3) * 0.5 AS mult, p_size AS head_dim, p_retailprice / 100.0 AS xm, "
         "p_retailprice / 50.0 AS xx, 1.0 + (p_partkey % 7) / 10.0 AS wk, p_retailprice / 1000.0 AS sb, "
         "64 + p_size AS seq_len FROM part")


def _ent(s: str) -> tuple[str, str]:
    e = f"exp(least({s}, 700.0))"
    p = f"({e} / ({e} + seq_len - 1.0))"
    q = f"((1.0 - {p}) / (seq_len - 1.0))"
    h = f"(-({p} * ln(least(greatest({p}, 1e-300), 1.0))) - (seq_len - 1.0) * {q} * ln(least(greatest({q}, 1e-300), 1.0)))"
    return h, f"({h} / ln(seq_len))"


_HM, _HMN = _ent("sm")
_HX, _HXN = _ent("sx")


@register("g12_sigma_bounds",
          "SELECT change, layer, step, round(sm, 9) AS sigma_bound_mean, round(sx, 9) AS sigma_bound_max, "
          "round(sm - sb, 9) AS sigma_bound_mean_logged_delta FROM "
          f"(SELECT *, mult / sqrt(head_dim) * xm * wk AS sm, mult / sqrt(head_dim) * xx * wk AS sx FROM ({_DIAG}) d) q")
def q_g12(spark, sf):
    d = rl.sigma_bounds(b.part_diagnostics(table(spark, sf, "part")))
    return d.select("change", "layer", "step", *[F.round(c, 9).alias(c) for c in
                    ("sigma_bound_mean", "sigma_bound_max", "sigma_bound_mean_logged_delta")])


@register("g13_entropy_lower_bound",
          f"SELECT change, layer, step, round({_HM}, 9) AS entropy_lower_bound_from_sigma_mean, "
          f"round({_HMN}, 9) AS entropy_lower_bound_from_sigma_mean_normalized, "
          f"round({_HX}, 9) AS entropy_lower_bound_from_sigma_max, "
          f"round({_HXN}, 9) AS entropy_lower_bound_from_sigma_max_normalized FROM "
          f"(SELECT *, mult / sqrt(head_dim) * xm * wk AS sm, mult / sqrt(head_dim) * xx * wk AS sx FROM ({_DIAG}) d) q")
def q_g13(spark, sf):
    d = rl.with_entropy(rl.sigma_bounds(b.part_diagnostics(table(spark, sf, "part"))))
    cols = [c for c in d.columns if c.startswith("entropy_lower_bound")]
    return d.select("change", "layer", "step", *[F.round(c, 9).alias(c) for c in cols])


@register("g14_lr_sweep_summary", _with(
    "SELECT r.run_name, (['2p4M', '9p4M', '19M', '42M'])[r.user_id % 4 + 1] AS model, "
    "CAST(2 + (r.user_id % 4) * 2 AS INTEGER) AS num_layers, CAST(64 * (1 + r.user_id % 4) AS INTEGER) AS model_dim, "
    "CAST('0.00' || CAST(r.user_id % 9 + 1 AS VARCHAR) AS DOUBLE) AS lr, r.state, "
    "min(CASE WHEN e.event_type = 'purchase' THEN e.value END) AS best_val_loss, "
    "arg_max(e.value, e.event_id) FILTER (WHERE e.event_type = 'view') AS last_train_loss, "
    "r.user_id % 7 = 0 AS failed "
    "FROM runs r JOIN ev e USING (run_id) WHERE r.run_name LIKE 'lr-sweep-%' "
    "GROUP BY r.run_name, r.user_id, r.state"))
def q_g14(spark, sf):
    return rl.lr_sweep_summary(b.runs(table(spark, sf, "events")))
