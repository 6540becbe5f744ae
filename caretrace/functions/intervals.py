"""Time joins that keep working when one key owns a third of the rows.

Three shapes, all bucketed on (key, clock bucket) so that no key is handled by a single task:

* ``points_in_intervals``  - every (interval, point) pair with the point inside,
* ``overlapping_intervals`` - every overlapping (interval, interval) pair,
* ``asof_bounds``          - nearest earlier and later point of every anchor, without pairs,
* ``running_counts``       - number of points up to every query time, without pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caretrace.functions.columns import time_bucket


def _buckets(start: Column | str, end: Column | str, hours: int) -> Column:
    first, last = time_bucket(start, hours), time_bucket(end, hours)
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def points_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    *,
    key: str,
    ts: str,
    start: str,
    end: str,
    closed_end: bool = False,
    bucket_hours: int = 24,
) -> DataFrame:
    """Pairs with ``start <= ts < end`` (``<= end`` when ``closed_end``).

    A point lives in exactly one bucket, so the equi-join on (key, bucket) yields each pair once.
    Points are the left side: that is the side AQE splits when a bucket is hot.
    """
    spread = intervals.withColumn("_b", F.explode(_buckets(start, end, bucket_hours)))
    tagged = points.filter(F.col(ts).isNotNull()).withColumn("_b", time_bucket(ts, bucket_hours))
    inside = (F.col(ts) >= F.col(start)) & ((F.col(ts) <= F.col(end)) if closed_end else (F.col(ts) < F.col(end)))
    return tagged.join(spread, [key, "_b"], "inner").filter(inside).drop("_b")


def overlapping_intervals(
    left: DataFrame,
    right: DataFrame,
    *,
    key: str,
    left_start: str,
    left_end: str,
    right_start: str,
    right_end: str,
    bucket_hours: int = 24,
) -> DataFrame:
    """Pairs whose open intervals overlap. A pair is kept only in the bucket of the later start."""
    a = left.withColumn("_b", F.explode(_buckets(left_start, left_end, bucket_hours)))
    b = right.withColumn("_b", F.explode(_buckets(right_start, right_end, bucket_hours)))
    return (
        a.join(b, [key, "_b"], "inner")
        .filter((F.col(right_end) > F.col(left_start)) & (F.col(right_start) < F.col(left_end)))
        .filter(F.col("_b") == time_bucket(F.greatest(left_start, right_start), bucket_hours))
        .drop("_b")
    )


def asof_bounds(
    anchors: DataFrame,
    points: DataFrame,
    *,
    keys: Sequence[str],
    anchor_ts: str,
    point_ts: str,
    point_cols: Sequence[str],
    bucket_hours: int = 24,
) -> DataFrame:
    """Every anchor with ``prev`` (last point at or before it) and ``next`` (first at or after it).

    ``prev``/``next`` are structs of (ts, *point_cols); ties in time go to the larger / smaller
    ``point_cols``. Anchors and points are merged and sorted inside (key, bucket); what lies outside
    the bucket comes from one carried row per (key, bucket).
    """
    keys = list(keys)
    carried = [c for c in anchors.columns if c not in keys]
    point = F.struct(F.col(point_ts).alias("ts"), *[F.col(c) for c in point_cols])
    p = points.filter(F.col(point_ts).isNotNull()).select(*keys, F.col(point_ts).alias("_t"), point.alias("_p"))
    a = anchors.filter(F.col(anchor_ts).isNotNull()).select(
        *keys, F.col(anchor_ts).alias("_t"), F.struct(*carried).alias("_a")
    )
    both = p.unionByName(a, allowMissingColumns=True).withColumn("_b", time_bucket("_t", bucket_hours))
    inside = Window.partitionBy(*keys, "_b")
    ahead = inside.orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    behind = inside.orderBy(F.col("_t").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = (
        both.withColumn("_prev", F.max("_p").over(ahead))
        .withColumn("_next", F.min("_p").over(behind))
        .filter(F.col("_a").isNotNull())
        .select(*keys, "_b", "_a", "_prev", "_next")
    )
    per_bucket = both.groupBy(*keys, "_b").agg(F.max("_p").alias("_mx"), F.min("_p").alias("_mn"))
    across = Window.partitionBy(*keys)
    carry = per_bucket.select(
        *keys,
        "_b",
        F.max("_mx").over(across.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.min("_mn").over(across.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"),
    )
    joined = local.join(carry, [*keys, "_b"], "left")
    return joined.select(
        *keys,
        *[F.col(f"_a.{c}").alias(c) for c in carried],
        F.coalesce("_prev", "_before").alias("prev"),
        F.coalesce("_next", "_after").alias("next"),
    )


def running_counts(
    queries: DataFrame,
    *,
    key: str,
    opened: DataFrame,
    closed: DataFrame,
    lower: str,
    upper: str,
    bucket_hours: int = 1,
) -> DataFrame:
    """Distinct (key, lower, upper) queries with ``n`` = members present at any time in [lower, upper].

    ``opened``/``closed`` hold (key, t): member start times and, for members that ended, end times
    with start <= end. n = #(start <= upper) - #(end < lower), read off two running counts, so the
    cost is a sort and never the (query, member) pairs.
    """
    q = queries.select(key, F.col(lower).alias("_lo"), F.col(upper).alias("_hi")).distinct()

    def marks(df: DataFrame, t: str, order: int, dopen: int, dclose: int, end: int | None) -> DataFrame:
        return df.select(
            key,
            F.col(t).alias("_t"),
            F.lit(order).alias("_o"),
            F.lit(dopen).cast("long").alias("_do"),
            F.lit(dclose).cast("long").alias("_dc"),
            F.lit(end).cast("int").alias("_end"),
            (F.col("_lo") if end is not None else F.lit(None).cast("timestamp_ntz")).alias("_lo"),
            (F.col("_hi") if end is not None else F.lit(None).cast("timestamp_ntz")).alias("_hi"),
        )

    # Order inside one instant: starts count for queries ending then, ends do not count for queries starting then.
    stream = (
        marks(opened, "t", 0, 1, 0, None)
        .unionByName(marks(q, "_lo", 1, 0, 0, 0))
        .unionByName(marks(q, "_hi", 1, 0, 0, 1))
        .unionByName(marks(closed, "t", 2, 0, 1, None))
        .withColumn("_b", time_bucket("_t", bucket_hours))
    )
    inside = Window.partitionBy(key, "_b").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (
        stream.withColumn("_so", F.sum("_do").over(inside))
        .withColumn("_sc", F.sum("_dc").over(inside))
        .filter(F.col("_end").isNotNull())
    )
    totals = stream.groupBy(key, "_b").agg(F.sum("_do").alias("_to"), F.sum("_dc").alias("_tc"))
    across = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        key,
        "_b",
        F.coalesce(F.sum("_to").over(across), F.lit(0)).alias("_bo"),
        F.coalesce(F.sum("_tc").over(across), F.lit(0)).alias("_bc"),
    )
    ends = local.join(base, [key, "_b"], "left").select(
        key,
        "_lo",
        "_hi",
        F.when(F.col("_end") == 1, F.col("_so") + F.col("_bo")).otherwise(F.lit(0)).alias("_started"),
        F.when(F.col("_end") == 0, F.col("_sc") + F.col("_bc")).otherwise(F.lit(0)).alias("_ended"),
    )
    return ends.groupBy(key, F.col("_lo").alias(lower), F.col("_hi").alias(upper)).agg(
        (F.sum("_started") - F.sum("_ended")).alias("n")
    )
