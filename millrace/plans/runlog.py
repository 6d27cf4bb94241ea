"""Binding of the driver tables to run-log inputs.

``events`` plays the step log: run = ``user_id``, step = ``event_id``,
layer = ``props.k % 8``, metric = ``event_type``, value = ``value``. Every event
is a history row; runs with ``user_id % 10 = 0`` log their values under
``train/<event_type>`` only, so their history holds no diagnostics (those live in
the summary). ``part`` plays the exported diagnostics table for G12/G13.
All tables are derived by Spark from the inputs, so work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of this binding (sweep model names indexed by user_id % 4).
MODELS = ("2p4M", "9p4M", "19M", "42M")


def _events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select("event_id", "user_id", "event_type", "value", "ts", k.alias("k"),
                         F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"))


def run_log(events: DataFrame) -> DataFrame:
    e = _events(events)
    key = F.when(F.pmod("user_id", F.lit(10)) == 0, F.concat(F.lit("train/"), F.col("event_type"))).otherwise(
        F.concat(F.lit("attention_diagnostics/layer_"), F.pmod("k", F.lit(8)).cast("string"), F.lit("/"), F.col("event_type")))
    step = F.col("event_id").cast("double")
    m = F.create_map(key, F.col("value"), F.lit("train/step"), step)
    m = F.when(F.pmod("event_id", F.lit(3)) != 0, F.map_concat(m, F.create_map(F.lit("_step"), step))).otherwise(m)
    return e.select("run_id", m.alias("metrics"))


def runs(events: DataFrame) -> DataFrame:
    e = _events(events)
    u = F.col("user_id")
    lr_text = F.concat(F.lit("0.00"), (F.pmod(u, F.lit(9)) + 1).cast("string"))
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.pmod(u, F.lit(4)) + 1).cast("int"))
    base = e.groupBy("user_id", "run_id").agg(
        F.min(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("best"),
        F.max_by(F.when(F.col("event_type") == "view", F.col("value")),
                 F.when(F.col("event_type") == "view", F.col("event_id"))).alias("last_train"),
        F.max("event_id").alias("last_step"))
    uid_s = u.cast("string")
    tag = F.concat(F.lit("qk-init-m-"), F.pmod(u, F.lit(5)).cast("string"))
    tags = (F.when(F.pmod(u, F.lit(6)) == 0, F.array(F.lit("qk-init-step0"), F.lit("qk-init-m-9"), tag))
             .when(F.pmod(u, F.lit(2)) == 0, F.array(F.lit("qk-init-step0"), F.concat(tag, F.lit(".0")), tag))
             .otherwise(F.array(F.lit("qk-init-step0"))))
    name = (F.when(F.pmod(u, F.lit(11)) == 0, F.lit(None).cast("string"))
             .when(F.pmod(u, F.lit(3)) == 0, F.concat(F.lit("lr-sweep-"), model, F.lit("-lr"), lr_text))
             .otherwise(F.concat(F.lit("trial-"), uid_s)))
    state = F.when(F.pmod(u, F.lit(7)) == 0, F.lit("failed")).otherwise(F.lit("finished"))

    def entry(key, value, cond=None):
        s = F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
        return s if cond is None else F.when(cond, s)

    entries = F.array(
        entry("config/qk_gain_init", u / 8.0, F.pmod(u, F.lit(8)) == 0),
        entry("config/qk_gain_init", F.pmod(u, F.lit(7)), F.pmod(u, F.lit(8)) == 4),
        entry("config/lr", lr_text, F.pmod(u, F.lit(6)) == 0),
        entry("config/num_layers", 2 + F.pmod(u, F.lit(4)) * 2),
        entry("config/model_dim", 64 * (1 + F.pmod(u, F.lit(4)))),
        entry("best_val_loss", F.col("best"), F.col("best").isNotNull()),
        entry("last_train_loss", F.col("last_train"), F.col("last_train").isNotNull()),
        entry("failed", F.lit("true"), F.pmod(u, F.lit(7)) == 0),
        entry("_step", F.col("last_step")),
    )
    general = base.select("user_id", "run_id", F.explode(F.filter(entries, lambda x: x.isNotNull())).alias("kv"))
    # Runs without history keep their last diagnostics in the summary.
    orphan = e.where(F.pmod("user_id", F.lit(10)) == 0)
    diag = orphan.groupBy("user_id", "run_id", F.pmod("k", F.lit(8)).alias("layer"), "event_type").agg(
        F.max_by("value", "event_id").alias("v"))
    diag_kv = diag.select("user_id", "run_id", F.struct(
        F.concat(F.lit("attention_diagnostics/layer_"), F.col("layer").cast("string"), F.lit("/"),
                 F.col("event_type")).alias("key"),
        F.col("v").cast("string").alias("value")).alias("kv"))
    summary = general.unionByName(diag_kv).groupBy("user_id", "run_id").agg(
        F.map_from_entries(F.collect_list("kv")).alias("summary"))       # <= ~50 entries per run
    meta = base.select("user_id", "run_id", name.alias("run_name"), state.alias("state"), tags.alias("tags"))
    return meta.join(summary, ["user_id", "run_id"]).drop("user_id")


def steps(events: DataFrame) -> DataFrame:
    """One row per step: train/val loss, gradient norm, tokens, resources."""
    e = _events(events)
    v, t = F.col("value"), F.col("event_type")
    return e.select(
        "run_id", F.col("event_id").alias("step"),
        F.when(t == "view", v).alias("train_loss"),
        F.when(t == "purchase", v).alias("val_loss"),
        F.when(t == "click", v).alias("grad_norm"),
        F.floor(v * 100).cast("bigint").alias("tokens"),
        (v / 4).alias("gpu_memory_reserved_gb"),
        (v * 1000).alias("tokens_per_sec"),
        (F.col("event_id") * 0.5).alias("elapsed_sec"), F.col("ts").cast("timestamp").alias("log_time"))


def stage_log(events: DataFrame) -> DataFrame:
    e = _events(events)
    rows = F.when(F.pmod("k", F.lit(5)) == 0, F.lit(None).cast("bigint")).otherwise(F.col("k").cast("bigint") * 100)
    return e.select(F.col("event_id").alias("stage_id"), F.col("event_type").alias("stage"),
                    F.col("value").alias("wall_time_sec"), rows.alias("rows_processed"))


def metric_log(events: DataFrame) -> DataFrame:
    """``(run_id, step, key, value)`` with keys from several namespaces."""
    e = _events(events)
    t = F.col("event_type")
    key = (F.when(t == "view", F.lit("optimizer/lr"))
            .when(t == "click", F.lit("diagnostics/grad_norm"))
            .when(t == "signup", F.lit("timing/elapsed_since_start_sec"))
            .when(t == "purchase", F.concat(F.lit("attention_diagnostics/layer_"),
                                            F.pmod("k", F.lit(8)).cast("string"), F.lit("/purchase")))
            .otherwise(F.lit("diagnostics/custom_error")))
    value = F.when(F.pmod("k", F.lit(13)) == 0, F.lit(None).cast("double")).otherwise(F.col("value"))
    return e.select("run_id", F.col("event_id").alias("step"), key.alias("key"), value.alias("value"))


def part_diagnostics(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select(
        F.col("p_brand").alias("change"), F.pmod(k, F.lit(8)).cast("int").alias("layer"), k.alias("step"),
        (1.0 + F.pmod(k, F.lit(3)) * 0.5).alias("attention_logit_multiplier"),
        F.col("p_size").alias("head_dim"),
        (F.col("p_retailprice") / 100.0).alias("xxt_norm_2_mean"),
        (F.col("p_retailprice") / 50.0).alias("xxt_norm_2_max"),
        (1.0 + F.pmod(k, F.lit(7)) / 10.0).alias("wk_wqT_norm_2"),
        (F.col("p_retailprice") / 1000.0).alias("score_norm_bound_mean"),
        (64 + F.col("p_size")).alias("seq_len"))
