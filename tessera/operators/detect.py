"""Event detection on traces, and comparison of event lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof
from .intervals import overlapping, points_in_intervals
from .islands import true_runs


def count_grid(points: DataFrame, intervals: DataFrame, keys: list[str], bin_s: float) -> DataFrame:
    """keys, interval_id, i, t, n: points in each bin of each interval, empty bins included; the last partial bin goes.

    intervals: keys, interval_id, start, end. Points are counted by bin before they meet the grid.
    """
    counted = points_in_intervals(points, intervals, keys).withColumn("i", F.floor((F.col("t") - F.col("start")) / bin_s).cast("long")).groupBy(*keys, "interval_id", "i").agg(F.count(F.lit(1)).alias("n"))
    bins = F.floor((F.col("end") - F.col("start")) / bin_s + 1e-9).cast("long")
    grid = intervals.withColumn("_bins", bins).where("_bins > 0").select(*keys, "interval_id", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_bins") - 1)).alias("i"))
    return grid.join(counted, [*keys, "interval_id", "i"], "left").select(*keys, "interval_id", "i", (F.col("start") + F.col("i") * bin_s).alias("t"), F.coalesce("n", F.lit(0)).alias("n"))


def baseline(trace: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """keys, mean, sd (population) pooled over all samples."""
    return trace.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def two_threshold(trace: DataFrame, keys: list[str], *, value: str = "v", i: str = "i", t: str = "t", low: Column, high: Column, merge_gap: float, min_duration: float, max_duration: float, dt: float, chunk: int | None = None) -> DataFrame:
    """keys, start, peak, end, peak_value of events in a trace that is ordered by ``i`` inside ``keys``.

    Runs at or above ``low`` that reach ``high`` are candidates. Candidates merge if the gap from the last
    sample of one to the first of the next is under ``merge_gap``; the peak is the first largest sample of
    the whole merged span, also between the runs. Durations (last sample + dt - first) are kept in
    [min_duration, max_duration]. low and high are expressions over the trace's columns.
    """
    over = trace.withColumn("_hi", (F.col(value) >= high).cast("int"))
    runs = true_runs(over, F.col(value) >= low, keys, i, chunk=chunk, values={"t0": ("min", t), "t1": ("max", t), "reached": ("max", "_hi")}).where("reached = 1")
    w = Window.partitionBy(*keys).orderBy("first")
    new = F.coalesce(F.col("t0") - F.lag("t1").over(w) >= merge_gap, F.lit(True)).cast("long")
    merged = runs.withColumn("_event", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).groupBy(*keys, "_event").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("t0").alias("start"), (F.max("t1") + dt).alias("end"))
    # Compared with a slack far below any sample step: both ends are sums of doubles.
    duration = F.col("end") - F.col("start")
    fine = merged.where((duration >= min_duration - 1e-9) & (duration <= max_duration + 1e-9)).drop("_event")
    inside = points_in_intervals(trace.select(*keys, i, t, value), fine.withColumn("stop", F.col("last") + 1), keys, t=i, start="first", end="stop", width=256.0)
    best = F.max_by(F.struct(F.col(t).alias("t"), F.col(value).alias("v")), F.struct(F.col(value), -F.col(i)))
    return inside.groupBy(*keys, "start", "end").agg(best.alias("_b")).select(*keys, "start", F.col("_b.t").alias("peak"), "end", F.col("_b.v").alias("peak_value"))


def participation(events: DataFrame, spikes: DataFrame, keys: list[str], event: str = "event_id", cell: str = "cluster_id", width: float = 60.0) -> DataFrame:
    """keys, event, n_active (distinct cells), n_spikes in [start, end); events without spikes have zeros."""
    met = points_in_intervals(spikes.select(*keys, cell, "t"), events.select(*keys, event, "start", "end"), keys, width=width).groupBy(*keys, event).agg(F.countDistinct(cell).alias("n_active"), F.count(F.lit(1)).alias("n_spikes"))
    return events.select(*keys, event).join(met, [*keys, event], "left").select(*keys, event, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_active", "n_spikes")))


def participation_by_group(events: DataFrame, spikes: DataFrame, keys: list[str], group: str = "shank", event: str = "event_id", cell: str = "cluster_id", width: float = 60.0) -> DataFrame:
    """keys, event, group, n_active: distinct active cells by event and group (groups without any are left out)."""
    met = points_in_intervals(spikes.select(*keys, cell, group, "t"), events.select(*keys, event, "start", "end"), keys, width=width)
    return met.groupBy(*keys, event, group).agg(F.countDistinct(cell).alias("n_active"))


def concentration(by_group: DataFrame, keys: list[str], event: str = "event_id") -> DataFrame:
    """keys, event, n_active, n_groups, concentration: the busiest group's share of active cells."""
    return by_group.groupBy(*keys, event).agg(F.sum("n_active").alias("n_active"), F.count_if(F.col("n_active") > 0).alias("n_groups"), F.try_divide(F.max("n_active"), F.sum("n_active")).alias("concentration"))


def compare_events(a: DataFrame, b: DataFrame, keys: list[str], near: float, width: float = 60.0) -> DataFrame:
    """keys, event_id of ``a`` with a partner in ``b`` (overlap, or peaks at most ``near`` apart), b_event_id and offset of the one whose peak is nearest (first on ties)."""
    cols = [*keys, "event_id", "start", "peak", "end"]
    pairs = overlapping(a.select(*cols), b.select(*cols), keys, near=near, width=width)
    offset = F.col("peak_b") - F.col("peak_a")
    best = F.min_by(F.struct(F.col("event_id_b").alias("id"), offset.alias("offset")), F.struct(F.abs(offset), F.col("event_id_b")))
    return pairs.groupBy(*keys, F.col("event_id_a").alias("event_id")).agg(best.alias("_m")).select(*keys, "event_id", F.col("_m.id").alias("b_event_id"), F.col("_m.offset").alias("offset"))


def overlap_summary(a: DataFrame, b: DataFrame, keys: list[str], near: float, width: float = 60.0) -> DataFrame:
    """keys, n_a, n_b, n_a_matched, n_b_matched, fraction_a, fraction_b."""
    n = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{s}")) for df, s in ((a, "a"), (b, "b"))]
    m = [compare_events(x, y, keys, near, width).groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{s}_matched")) for x, y, s in ((a, b, "a"), (b, a, "b"))]
    out = n[0]
    for df in (n[1], *m):
        out = out.join(df, keys, "full")
    out = out.fillna(0, ["n_a", "n_b", "n_a_matched", "n_b_matched"])
    return out.withColumn("fraction_a", F.try_divide("n_a_matched", "n_a")).withColumn("fraction_b", F.try_divide("n_b_matched", "n_b"))


def nearest_within(query: DataFrame, reference: DataFrame, keys: list[str], window: float, t: str = "t", ref_id: str = "ref_id") -> DataFrame:
    """``query`` with ref_id of the nearest reference time at most ``window`` away (ties: the earlier), -1 if none."""
    return asof(query, reference, keys, t=t, values=[ref_id], tolerance=window).withColumn(ref_id, F.coalesce(ref_id, F.lit(-1)))


def repeak(trace: DataFrame, events: DataFrame, keys: list[str], value: str = "v", width: float = 1.0) -> DataFrame:
    """events with the peak moved to the first largest sample of the trace inside [start, end]."""
    inside = points_in_intervals(trace, events, keys, closed="both", width=width)
    best = F.max_by("t", F.struct(F.col(value), -F.col("t")))
    moved = inside.groupBy(*keys, "event_id").agg(best.alias("_peak"))
    return events.join(moved, [*keys, "event_id"], "left").withColumn("peak", F.coalesce("_peak", "peak")).drop("_peak")


def sample_windows(intervals: DataFrame, keys: list[str], window: float, n: int) -> DataFrame:
    """keys, k, start, end: ``n`` windows spread evenly over the total room of all intervals that can hold one.

    An interval's room is its length less one window. Targets (k + 0.5)/n of the total room fall into the
    first interval whose running room passes them.
    """
    w = Window.partitionBy(*keys).orderBy("start")
    rooms = intervals.withColumn("_room", F.col("end") - F.col("start") - window).where("_room >= 0")
    rooms = rooms.withColumn("_upto", F.sum("_room").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_total", F.sum("_room").over(Window.partitionBy(*keys)))
    target = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(k.alias("k"), ((k + 0.5) / n * F.col("_total")).alias("at")))
    here = F.filter(target, lambda x: (x["at"] >= F.col("_upto") - F.col("_room")) & (x["at"] < F.col("_upto")))
    hit = rooms.withColumn("_x", F.explode(here))
    start = F.col("start") + F.col("_x.at") - (F.col("_upto") - F.col("_room"))
    return hit.select(*keys, F.col("_x.k").alias("k"), start.alias("start"), (start + window).alias("end"))


def within_budget(intervals: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """The first intervals whose running length stays in the budget; the very first always."""
    w = Window.partitionBy(*keys).orderBy("start")
    upto = F.sum(F.col("end") - F.col("start")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return intervals.withColumn("_upto", upto).withColumn("_n", F.row_number().over(w)).where((F.col("_upto") <= seconds) | (F.col("_n") == 1)).drop("_upto", "_n")
