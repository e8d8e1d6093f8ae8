"""Tables that a chart reads as they are: the engine draws nothing itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, keys: list[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """keys, bin, left, right, n with empty bins; values are in [lo, hi], the last bin is closed."""
    width = (hi - lo) / bins
    at = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    n = df.where((F.col(value) >= lo) & (F.col(value) <= hi)).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    spine = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return spine.join(n, [*keys, "bin"], "left").fillna(0, ["n"]).select(*keys, "bin", (lo + F.col("bin") * width).alias("left"), (lo + (F.col("bin") + 1) * width).alias("right"), "n")


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n, share of rows up to it: one row for each distinct value."""
    n = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    return n.withColumn("share", F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("n").over(w))


def heatmap(maps: DataFrame, keys: list[str], rate: str = "rate") -> DataFrame:
    """keys, position (order by peak bin), bin, v: rate maps divided by their peak. maps: keys and an ARRAY rate."""
    from .fields import peak_bin

    rows = maps.withColumn("_peak", peak_bin(F.col(rate))).withColumn("_top", F.array_max(rate)).where("_top > 0")
    rows = rows.withColumn("position", F.row_number().over(Window.orderBy("_peak", *keys)) - 1)  # a row for each cell
    return rows.select(*keys, "position", F.posexplode(rate).alias("bin", "_r"), "_top").select(*keys, "position", "bin", (F.col("_r") / F.col("_top")).alias("v"))


def top(df: DataFrame, value: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(value), *ties).limit(n)


def spread_examples(df: DataFrame, keys: list[str], value: str, n: int, *ties: str) -> DataFrame:
    """``n`` rows of each key spread over the order of the value: the first of each n-th part."""
    w = Window.partitionBy(*keys).orderBy(value, *ties)
    rows = df.withColumn("_part", F.ntile(n).over(w))
    first = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(value, *ties))
    return rows.withColumn("_first", first).where("_first = 1").drop("_part", "_first")


def rate_over_session(events: DataFrame, keys: list[str], window_s: float, t: str = "peak") -> DataFrame:
    """keys, start, per_minute: events in windows laid end to end; windows without events are left out."""
    return events.groupBy(*keys, F.floor(F.col(t) / window_s).alias("_k")).agg(F.count(F.lit(1)).alias("n")).select(*keys, (F.col("_k") * window_s).alias("start"), (F.col("n") * 60 / window_s).alias("per_minute"))


def normalised(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``df`` with the value divided by the largest of its group."""
    return df.withColumn(value, F.try_divide(F.col(value), F.max(value).over(Window.partitionBy(*by))))


def shares(df: DataFrame, keys: list[str], group: str, weight: str) -> DataFrame:
    """keys, group, share of the key's weight."""
    n = df.groupBy(*keys, group).agg(F.sum(weight).alias("_w"))
    return n.select(*keys, group, F.try_divide(F.col("_w"), F.sum("_w").over(Window.partitionBy(*keys))).alias("share"))


def rasters(spikes: DataFrame, events: DataFrame, keys: list[str], width: float = 60.0) -> DataFrame:
    """keys, event_id, cluster_id, dt: spikes of each event, in seconds from its peak."""
    from .intervals import points_in_intervals

    return points_in_intervals(spikes, events, keys, width=width).select(*keys, "event_id", "cluster_id", (F.col("t") - F.col("peak")).alias("dt"))
