"""ST2: state that expires, replays, and runs that come back."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.streaming.streams import latest_monitor, monitor_aggregates, monitor_stream, publish_monitor

SCHEMA = "run_id string, step long, train_loss double, val_loss double, grad_norm double, tokens long, log_time timestamp_ntz"
T = datetime(2024, 1, 1)


def _row(run, step, day, loss=1.0, val=None, tokens=10):
    return (run, step, loss, val, 0.5, tokens, None if day is None else T + timedelta(days=day))


BATCHES = [
    [_row("a", 1, 0, val=3.0), _row("b", 1, 0), _row("c", 5, 1, loss=float("nan")), _row(None, 1, 1), _row("z", 1, None)],
    [_row("a", 2, 9, val=2.0), _row("d", 1, 10, tokens=None)],                    # b, c and the null run expire
    [_row("a", 3, 11, val=4.0), _row("b", 2, 12, val=0.5), _row("c", 4, 0)],      # b and (late) c come back
]


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_three_batches_a_replay_and_an_expired_run(spark, tmp_path):
    src, out, ck = (os.path.join(tmp_path, x) for x in ("src", "out", "ck"))
    schema = spark.createDataFrame([], SCHEMA).schema
    sizes = []
    for k, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        monitor_stream(spark.readStream.schema(schema).parquet(src), out, ck, expire="7 days").awaitTermination()
        seen = spark.createDataFrame([r for b in BATCHES[:k + 1] for r in b], schema)
        assert _sorted(latest_monitor(spark, out)) == _sorted(monitor_aggregates(seen))
        sizes.append({r.run_id for r in spark.read.parquet(f"{out}/open/epoch={k}").collect()})
    assert sizes == [{"a", "b", "c", None, "z"}, {"a", "d", "z"}, {"a", "b", "d", "z"}]     # without a log time: never
    want = _sorted(latest_monitor(spark, out))
    for epoch in (2, 2):                                                    # the last epoch is replayed
        publish_monitor(spark.createDataFrame(BATCHES[epoch], schema), epoch, out, "7 days")
        assert _sorted(latest_monitor(spark, out)) == want


def test_an_unfinished_epoch_is_not_read(spark, tmp_path):
    out = str(tmp_path)
    publish_monitor(spark.createDataFrame(BATCHES[0], SCHEMA), 0, out, "7 days")
    want = _sorted(latest_monitor(spark, out))
    spark.createDataFrame(BATCHES[1], SCHEMA).write.parquet(f"{out}/closed/epoch=1")       # lost before its commit
    assert _sorted(latest_monitor(spark, out)) == want
    publish_monitor(spark.createDataFrame(BATCHES[1], SCHEMA), 1, out, "7 days")
    assert _sorted(latest_monitor(spark, out)) == _sorted(monitor_aggregates(spark.createDataFrame(BATCHES[0] + BATCHES[1], SCHEMA)))


def test_without_log_times_nothing_expires(spark, tmp_path):
    df = spark.createDataFrame(BATCHES[0], SCHEMA).drop("log_time")
    publish_monitor(df, 0, str(tmp_path), "7 days")
    assert spark.read.parquet(f"{tmp_path}/closed").where(F.lit(True)).count() == 0
    assert _sorted(latest_monitor(spark, str(tmp_path))) == _sorted(monitor_aggregates(df))
