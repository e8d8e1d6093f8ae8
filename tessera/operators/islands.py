"""Runs of a flag over ordered samples, and operators built on runs.

Samples carry a whole-number index ``i`` that grows by one. With ``chunk`` set, runs are found inside
chunks of so many samples, and only the runs (not the samples) are joined up over chunk borders, so a
single very long trace is dealt out over tasks. Results don't depend on ``chunk``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Aggregates whose results over parts give that of the whole.
MERGED = {"min": F.min, "max": F.max, "sum": F.sum}


def true_runs(df: DataFrame, flag: Column, keys: list[str], i: str = "i", *, chunk: int | None = None, values: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """keys, first, last, n and aggregates of each maximal run of consecutive indexes where ``flag`` holds.

    values: name -> (min, max or sum, column of the run's samples). A NULL flag is FALSE. Only samples that hold the flag are shuffled.
    """
    part = [*keys, "_chunk"]
    held = df.where(F.coalesce(flag, F.lit(False))).withColumn("_chunk", F.floor(F.col(i) / chunk).cast("long") if chunk else F.lit(0).cast("long"))
    # Consecutive indexes minus their rank are constant: no FALSE samples are needed.
    island = F.col(i) - F.row_number().over(Window.partitionBy(*part).orderBy(i))
    values = values or {}
    local = held.withColumn("_island", island).groupBy(*part, "_island").agg(F.min(i).alias("first"), F.max(i).alias("last"), *(MERGED[how](column).alias(name) for name, (how, column) in values.items()))
    if not chunk:
        return local.select(*keys, "first", "last", (F.col("last") - F.col("first") + 1).alias("n"), *values)
    order = Window.partitionBy(*keys).orderBy("first")
    new = F.coalesce(F.lag("last").over(order) + 1 != F.col("first"), F.lit(True)).cast("long")
    runs = local.withColumn("_run", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    again = [MERGED[how](name).alias(name) for name, (how, _) in values.items()]
    return runs.groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), *again).select(*keys, "first", "last", (F.col("last") - F.col("first") + 1).alias("n"), *values)


def mask_to_intervals(df: DataFrame, flag: Column, keys: list[str], *, i: str = "i", t: str = "t", dt: float, chunk: int | None = None) -> DataFrame:
    """keys, start, end, n: runs of the flag as half-open intervals, the last sample's step included."""
    runs = true_runs(df, flag, keys, i, chunk=chunk, values={"start": ("min", t), "stop": ("max", t)})
    return runs.select(*keys, "start", (F.col("stop") + dt).alias("end"), "n")


def intervals_to_mask(df: DataFrame, intervals: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Rows of ``df`` that lie in any ``[start, end)``; a sample in two intervals stays once."""
    from .intervals import points_in_intervals

    return points_in_intervals(df, intervals, keys, t=t, how="left_semi")


def bridge_short_gaps(df: DataFrame, flag: str, allowed: Column, keys: list[str], i: str, max_gap: int) -> DataFrame:
    """``df`` with ``flag`` also TRUE in FALSE runs of at most ``max_gap`` samples between TRUE ones, if ``allowed`` holds in all of the run."""
    order = Window.partitionBy(*keys).orderBy(i)
    own = F.coalesce(F.col(flag), F.lit(False))
    back = F.last(F.when(own, F.col(i)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.first(F.when(own, F.col(i)), ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    gap = Window.partitionBy(*keys, "_back")
    rows = df.withColumn("_own", own).withColumn("_back", back).withColumn("_ahead", ahead)
    fine = F.min(F.when(~F.col("_own"), F.coalesce(allowed, F.lit(False)).cast("int"))).over(gap) == 1
    fill = ~F.col("_own") & F.col("_back").isNotNull() & F.col("_ahead").isNotNull() & (F.col("_ahead") - F.col("_back") - 1 <= max_gap) & fine
    return rows.withColumn(flag, F.col("_own") | F.coalesce(fill, F.lit(False))).drop("_own", "_back", "_ahead")


def drop_short_runs(df: DataFrame, flag: str, keys: list[str], i: str, min_len: int) -> DataFrame:
    """``df`` with ``flag`` FALSE in TRUE runs of fewer than ``min_len`` samples."""
    own = F.coalesce(F.col(flag), F.lit(False))
    rows = df.withColumn("_own", own).withColumn("_island", F.row_number().over(Window.partitionBy(*keys).orderBy(i)) - F.row_number().over(Window.partitionBy(*keys, "_own").orderBy(i)))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_own", "_island"))
    return rows.withColumn(flag, F.col("_own") & (n >= min_len)).drop("_own", "_island")


def hysteresis(signal: Column, threshold: float, keys: list[str], order: str) -> Column:
    """+1 from the first sample above the threshold, -1 from the first under its negative, held between; 0 before either."""
    mark = F.when(signal > threshold, 1).when(signal < -threshold, -1)
    return F.coalesce(F.last(mark, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))


def gradient(x: Column, t: Column, keys: list[str], order: str) -> Column:
    """Second-order central difference for uneven steps; one-sided at both ends."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = t - F.lag(t).over(w), F.lead(t).over(w) - t
    down, up = x - F.lag(x).over(w), F.lead(x).over(w) - x
    central = (before * before * up + after * after * down) / (before * after * (before + after))
    return F.when(F.lag(t).over(w).isNull(), up / after).when(F.lead(t).over(w).isNull(), down / before).otherwise(central)


def leading_monotone_run(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, n: length of the strictly rising beginning (1 for a single value)."""
    w = Window.partitionBy(*keys).orderBy(order)
    rises = F.coalesce(F.col(value) > F.lag(value).over(w), F.lag(value).over(w).isNull())
    rows = df.withColumn("_up", rises.cast("int"))
    still = F.min("_up").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_still", still).groupBy(*keys).agg(F.sum("_still").cast("long").alias("n"))
