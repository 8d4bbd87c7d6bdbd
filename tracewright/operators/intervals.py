"""Interval joins as equi joins on (key, bucket)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.operators.ordered import time_bucket


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], point: str,
                        start: str, stop: str, width: float, closed: bool = False) -> DataFrame:
    """Pairs with ``start <= point < stop`` (``<=`` on both sides when ``closed``).

    An interval is listed under every bucket it covers, a point under its own, so
    a pair meets exactly once and a long recording spreads over many tasks. Choose
    ``width`` near the typical interval length.
    """
    buckets = F.explode(F.sequence(time_bucket(F.col(start), width), time_bucket(F.col(stop), width)))
    left = points.withColumn("_bucket", time_bucket(F.col(point), width))
    right = intervals.withColumn("_bucket", buckets)
    upper = F.col(point) <= F.col(stop) if closed else F.col(point) < F.col(stop)
    return (left.join(right, [*keys, "_bucket"])
            .filter((F.col(point) >= F.col(start)) & upper).drop("_bucket"))


def any_point_inside(windows: DataFrame, points: DataFrame, keys: list[str], start: str,
                     point: str, length: Column | float, name: str) -> DataFrame:
    """Boolean column: some point lies in the closed [start, start + length].

    Buckets are half a window long, so points of the window's own bucket can only
    lie before the start, points of the next buckets only after the end: the largest
    point of the one and the smallest of the others decide. Points are reduced to
    one row per bucket before the join and every window meets at most one row.
    ``length`` is a number, or a column name of both tables constant per key.
    """
    size = F.lit(float(length)) if isinstance(length, (int, float)) else F.col(length)
    half = lambda t: F.floor(F.col(t) / (size / 2)).cast("bigint")
    per_bucket = (points.withColumn("_bucket", half(point)).groupBy(*keys, "_bucket")
                  .agg(F.max(point).alias("_max"), F.min(point).alias("_min")))
    shifted = per_bucket.withColumn("_shift", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    facts = (shifted.groupBy(*keys, (F.col("_bucket") - F.col("_shift")).alias("_bucket"))
             .agg(F.max(F.when(F.col("_shift") == 0, F.col("_max"))).alias("_own_max"),
                  F.min(F.when(F.col("_shift") > 0, F.col("_min"))).alias("_next_min")))
    hit = (F.col("_own_max") >= F.col(start)) | (F.col("_next_min") <= F.col(start) + size)
    return (windows.withColumn("_bucket", half(start)).join(facts, [*keys, "_bucket"], "left")
            .withColumn(name, F.coalesce(hit, F.lit(False))).drop("_bucket", "_own_max", "_next_min"))
