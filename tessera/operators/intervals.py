"""Joins of points with intervals and of intervals with intervals.

Both sides are cut into time buckets, so the join is an equi-join on (keys, bucket) with an exact residual
test: no nested loop, and a long recording is dealt out by bucket. ``width`` should be about the
90th percentile of the interval lengths; it changes speed, never results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(t: Column, width: float) -> Column:
    return F.floor(t / F.lit(float(width))).cast("long")


def bucketed(intervals: DataFrame, width: float, start: str, end: str, name: str = "_bucket") -> DataFrame:
    """One row for each bucket an interval touches; reversed or null intervals have none."""
    return intervals.where(F.col(end) >= F.col(start)).withColumn(name, F.explode(F.sequence(bucket(F.col(start), width), bucket(F.col(end), width))))


def inside(t: Column, start: Column, end: Column, closed: str) -> Column:
    """closed: "left" is [start, end), "both" is [start, end]."""
    if closed not in ("left", "both"):
        raise ValueError("closed is left or both")
    return (t >= start) & ((t < end) if closed == "left" else (t <= end))


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], *, t: str = "t", start: str = "start", end: str = "end", closed: str = "left", width: float = 60.0, how: str = "inner") -> DataFrame:
    """Range join; how: inner (a row for each point and interval), left_semi or left_anti (points only)."""
    p = points.withColumn("_bucket", bucket(F.col(t), width)).alias("p")
    v = bucketed(intervals, width, start, end).alias("v")
    on = [F.col(f"p.{k}") == F.col(f"v.{k}") for k in [*keys, "_bucket"]]
    on.append(inside(F.col(f"p.{t}"), F.col(f"v.{start}"), F.col(f"v.{end}"), closed))
    joined = p.join(v, on, how)
    if how != "inner":
        return joined.drop("_bucket")
    return joined.select(*(F.col(f"p.{c}") for c in points.columns), *(F.col(f"v.{c}") for c in intervals.columns if c not in points.columns))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], *, width: float = 60.0, near: float | None = None, peak: str = "peak", how: str = "inner", suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Pairs whose intervals overlap strictly; with ``near``, also pairs with peaks at most so far apart.

    Reversed and null intervals have no partner. Every interval is widened by half of ``near`` on each side before it is cut into buckets. A pair that
    shares several buckets is reported in the first it shares.
    """
    pad = F.lit((near or 0.0) / 2)

    def cut(df: DataFrame, side: str) -> DataFrame:
        lo = F.least(F.col("start"), F.col(peak)) - pad if near is not None else F.col("start")
        hi = F.greatest(F.col("end"), F.col(peak)) + pad if near is not None else F.col("end")
        named = df.where(F.col("end") >= F.col("start")).select(*keys, *(F.col(c).alias(c + side) for c in df.columns if c not in keys), bucket(lo, width).alias("_first" + side), bucket(hi, width).alias("_last" + side))
        return named.where(F.col("_last" + side) >= F.col("_first" + side)).withColumn("_bucket", F.explode(F.sequence("_first" + side, "_last" + side)))

    sa, sb = suffixes
    left, right = cut(a, sa), cut(b, sb).hint("merge")  # Spark knows the size of the files alone, not how many buckets a side is cut into: it must not broadcast one
    test = (F.col("start" + sb) < F.col("end" + sa)) & (F.col("end" + sb) > F.col("start" + sa))
    if near is not None:
        test = test | (F.abs(F.col(peak + sb) - F.col(peak + sa)) <= near)
    if how == "inner":
        pairs = left.join(right, [*keys, "_bucket"]).where(test & (F.col("_bucket") == F.greatest("_first" + sa, "_first" + sb)))
        return pairs.drop("_bucket", *(f"_{w}{s}" for w in ("first", "last") for s in suffixes))
    on = [left[k] == right[k] for k in [*keys, "_bucket"]] + [test]
    names = [c for c in a.columns if c not in keys]
    met = left.join(right, on, "left_semi").select(*keys, *(F.col(c + sa).alias(c) for c in names)).distinct()
    if how == "left_semi":
        return met
    return a.join(met.select(*keys, *names), [*keys, *names], "left_anti")


def overlap_seconds(a: DataFrame, b: DataFrame, keys: list[str], width: float = 60.0) -> DataFrame:
    """keys, n_pairs, seconds over all overlapping pairs."""
    shared = F.least("end_a", "end_b") - F.greatest("start_a", "start_b")
    return overlapping(a, b, keys, width=width).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(shared).alias("seconds"))


def clean_intervals(df: DataFrame) -> DataFrame:
    return df.where(F.col("end") > F.col("start"))


def clipped(intervals: DataFrame, to: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals cut to one interval (lo, hi) for each key; what is left empty goes."""
    joined = intervals.join(to, keys)
    return clean_intervals(joined.withColumn("start", F.greatest("start", "lo")).withColumn("end", F.least("end", "hi")).drop("lo", "hi"))


def rate_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], by: list[str], width: float = 60.0) -> DataFrame:
    """by, n, rate: points in the closed intervals over their total length; NULL without any time."""
    total = intervals.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("_seconds"))
    n = points_in_intervals(points, intervals, keys, closed="both", width=width).groupBy(*keys, *by).agg(F.count(F.lit(1)).alias("n"))
    every = points.select(*keys, *by).distinct()
    return every.join(n, [*keys, *by], "left").join(total, keys, "left").select(*keys, *by, F.coalesce("n", F.lit(0)).alias("n"), F.try_divide(F.coalesce("n", F.lit(0)), F.when(F.col("_seconds") > 0, F.col("_seconds"))).alias("rate"))
