"""Dense position and running sums in a total order, without funnelling
the data through one task.

1. The input is written once (reliable checkpoint), so sampling it for range
   bounds does not evaluate it twice.
2. ``repartitionByRange`` on the order (plus optional group) columns and sort
   within partitions: partition ``p`` holds a contiguous slice of the order. The
   partition's number becomes a column before a second checkpoint fixes the
   layout, so later plans may coalesce or union the partitions.
3. Groups are contiguous too, so only the first group of a partition can have
   begun earlier: one row per partition (its first and last group, the last
   group's totals) goes to the driver and gives the exclusive offsets, whatever
   the number of groups.
4. An Arrow pass adds the running sum of the weight to the offset (NumPy
   ``cumsum``; Python touches batches and runs of a group, not rows).

Never a ``Window.orderBy`` without ``partitionBy`` over the corpus. Select the
columns you need first: what is passed in is what is written.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import cut_lineage


def global_positions(df: DataFrame, order_cols: Sequence[str], weight: str | None = None,
                     group_cols: Sequence[str] = (), pos_col: str = "pos",
                     before_col: str = "cum_before", num_partitions: int | None = None,
                     agg: str = "sum", unique: bool = False, part_col: str | None = None) -> DataFrame:
    """Adds ``pos`` (0-based index in the order) and, with ``weight``, the
    exclusive running aggregate ``cum_before`` (``agg="sum"``: running total;
    ``agg="min"``: smallest earlier value, null for the first row); both
    restart for each group.

    ``order_cols`` must make the order total (append a unique key); with
    ``unique`` a repeated key of a group is an error (nulls are values).
    ``part_col``: also keep the number of the row's range partition; rows of a
    partition stay in order.
    """
    if agg not in ("sum", "min"):
        raise ValueError(f"unknown agg {agg!r}")
    is_min = agg == "min"
    spark = df.sparkSession
    group_cols, order_cols = list(group_cols), list(order_cols)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if is_min:
        wcol = F.coalesce(F.col(weight).cast("double"), F.lit(float("inf")))
    else:
        wcol = F.coalesce(F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint"),
                          F.lit(0).cast("bigint"))
    gkey = F.to_json(F.array(*[F.col(c).cast("string") for c in group_cols])) if group_cols else F.lit("[]")
    ranged = (cut_lineage(df).withColumn("_w", wcol).withColumn("_g", gkey)
                .repartitionByRange(n, *group_cols, *order_cols)
                .sortWithinPartitions(*group_cols, *order_cols)
                .withColumn("__part", F.spark_partition_id())
                .withColumn("__row", F.monotonically_increasing_id())
                .withColumn("__key", F.xxhash64(*[x for c in [*group_cols, *order_cols] for x in (F.col(c), F.col(c).isNull())])
                            if unique else F.lit(None).cast("bigint")))
    ranged = cut_lineage(ranged)

    per_group = ranged.groupBy("__part", "_g").agg(F.count(F.lit(1)).alias("c"), (F.min if is_min else F.sum)("_w").alias("w"),
                                               F.min("__row").alias("i"))
    ends = per_group.groupBy("__part").agg(F.min_by("_g", "i").alias("first"), F.max_by("_g", "i").alias("last"),
                                       F.max_by(F.struct("c", "w"), F.col("i")).alias("t")).collect()   # one row per partition
    start = float("inf") if is_min else 0
    offsets: dict[int, tuple] = {}
    group, c, w = None, 0, start            # the group that the partitions so far end in, and its totals
    for r in sorted(ends, key=lambda r: r["__part"]):
        begun = group == r["first"]
        offsets[r["__part"]] = (c, w) if begun else (0, start)
        goes_on = begun and r["first"] == r["last"]
        c = r["t"]["c"] + (c if goes_on else 0)
        if is_min:
            w = min(r["t"]["w"], w) if goes_on else r["t"]["w"]
        else:
            w = r["t"]["w"] + (w if goes_on else 0)
        group = r["last"]

    out_schema = T.StructType(ranged.schema.fields + [
        T.StructField(pos_col, T.LongType(), False),
        T.StructField(before_col, T.DoubleType() if is_min else T.LongType(), is_min),
    ])
    before_type = pa.float64() if is_min else pa.int64()

    def scan(batches):
        now, c0, w0 = None, 0, start        # (partition, group) being read, its totals so far
        key = None
        for batch in batches:
            if unique and batch.num_rows:   # equal keys stand next to each other, in one partition
                k = batch.column("__key").to_numpy()
                if k[0] == key or (k[1:] == k[:-1]).any():
                    raise ValueError(f"rows with equal keys {order_cols} have no order")
                key = k[-1]
            g = batch.column("_g").to_numpy(zero_copy_only=False)
            p = batch.column("__part").to_numpy(zero_copy_only=False)
            w = batch.column("_w").to_numpy(zero_copy_only=False).astype(np.float64 if is_min else np.int64)
            pos = np.empty(len(g), dtype=np.int64)
            before = np.empty(len(g), dtype=w.dtype)
            # Rows are sorted by group within a partition, so each group is one run.
            bounds = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (p[1:] != p[:-1]), True])
            for s, e in zip(bounds[:-1], bounds[1:]):
                if (p[s], g[s]) != now:
                    if now is None or now[0] != p[s]:
                        if int(p[s]) not in offsets:
                            raise RuntimeError(f"no offset for partition {p[s]}: the layout has changed")
                        c0, w0 = offsets[int(p[s])]
                    else:
                        c0, w0 = 0, start
                    now = (p[s], g[s])
                pos[s:e] = c0 + np.arange(e - s, dtype=np.int64)
                if is_min:
                    run = np.minimum(np.minimum.accumulate(w[s:e]), w0)
                    before[s:e] = np.r_[w0, run[:-1]]
                    w0 = float(run[-1])
                else:
                    cs = np.cumsum(w[s:e])
                    before[s:e] = w0 + cs - w[s:e]
                    w0 += int(cs[-1])
                c0 += e - s
            out = pa.array(before, mask=np.isinf(before)) if is_min else pa.array(before)
            yield pa.RecordBatch.from_arrays(
                list(batch.columns) + [pa.array(pos), out],
                schema=batch.schema.append(pa.field(pos_col, pa.int64(), False))
                                   .append(pa.field(before_col, before_type, is_min)))

    out = ranged.mapInArrow(scan, out_schema)
    if part_col:
        out = out.withColumn(part_col, F.col("__part"))
    return out.drop("_w", "_g", "__part", "__row", "__key")
