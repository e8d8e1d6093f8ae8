"""Position traces: speed, running, laps, linearisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import gaussian_weights, smooth_trace, smooth_trace_nan_aware
from ..functions import axis as ax
from .chunks import over_chunks
from .islands import bridge_short_gaps, drop_short_runs, gradient, hysteresis


def _reach(sigma_s: float, dt: float) -> int:
    """Samples on either side that a smoothed speed depends on: the kernel's radius, and one for the gradient."""
    return len(gaussian_weights(sigma_s / dt)) // 2 + 1


def speed_cm_s(position: DataFrame, sigma_s: float, dt: float, keys: list[str] | None = None, *, chunk: int | None = None) -> DataFrame:
    """``position`` with speed: central-difference 2-D speed in cm/s, smoothed over defined samples only; in chunks of samples if ``chunk`` is set."""
    keys = keys or ["session"]
    if chunk:
        return over_chunks(position, lambda rows, part: speed_cm_s(rows, sigma_s, dt, part), keys, "sample", chunk, _reach(sigma_s, dt))
    vx, vy = (gradient(F.col(c) * 100, F.col("t"), keys, "sample") for c in ("x", "y"))
    raw = position.withColumn("_vx", vx).withColumn("_vy", vy).withColumn("_raw", F.hypot("_vx", "_vy"))
    return smooth_trace_nan_aware(raw, "_raw", keys, "sample", sigma_s / dt, out="speed").drop("_vx", "_vy", "_raw")


def running_mask(position: DataFrame, *, dt: float, threshold: float = 15.0, sigma_s: float = 0.1, min_run_s: float = 0.5, max_gap_s: float = 0.2, require_linear: bool = True, keys: list[str] | None = None, chunk: int | None = None) -> DataFrame:
    """``position`` with speed and running: at least the threshold (closed) where the 1-D position is defined, short slow gaps bridged if all their samples are defined, short runs dropped."""
    keys = keys or ["session"]
    if chunk:
        halo = _reach(sigma_s, dt) + int(round(max_gap_s / dt)) + 1 + int(round(min_run_s / dt))
        return over_chunks(position, lambda rows, part: running_mask(rows, dt=dt, threshold=threshold, sigma_s=sigma_s, min_run_s=min_run_s, max_gap_s=max_gap_s, require_linear=require_linear, keys=part), keys, "sample", chunk, halo)
    base = F.col("x1d").isNotNull() if require_linear else F.lit(True)
    rows = speed_cm_s(position, sigma_s, dt, keys).withColumn("_base", base)
    rows = rows.withColumn("running", F.coalesce(F.col("_base") & (F.col("speed") >= threshold), F.lit(False)))
    rows = bridge_short_gaps(rows, "running", F.col("_base"), keys, "sample", int(round(max_gap_s / dt)))
    return drop_short_runs(rows, "running", keys, "sample", int(round(min_run_s / dt))).drop("_base")


def running_summary(rows: DataFrame, dt: float, keys: list[str] | None = None) -> DataFrame:
    """keys, n_base, n_running, seconds, fraction_kept, median_speed of running samples."""
    keys = keys or ["session"]
    n = F.count_if(F.col("running"))
    base = F.count("x1d")
    return rows.groupBy(*keys).agg(base.alias("n_base"), n.alias("n_running"), (n * dt).alias("seconds"), F.try_divide(n, base).alias("fraction_kept"), F.percentile(F.when(F.col("running"), F.col("speed")), 0.5).alias("median_speed"))


def segment_laps(position: DataFrame, track: ax.Axis, *, dt: float, sigma_s: float = 0.25, threshold_cm_s: float = 5.0, min_coverage: float = 0.5, min_s: float = 0.5, max_s: float = 60.0, keys: list[str] | None = None) -> DataFrame:
    """keys, lap, direction (pos or neg), start_sample, stop_sample (half-open), t_start, t_end, x_start, x_end, coverage.

    Each stretch of defined position is unwrapped and smoothed; the sign of its velocity is latched; a lap
    ends where the latch turns or, on a ring, where a circuit is full. Laps out of range in duration or coverage go.
    """
    keys = keys or ["session"]
    order = Window.partitionBy(*keys).orderBy("sample")
    rows = position.withColumn("_ok", F.col("x1d").isNotNull())
    block = F.sum(F.coalesce(F.col("_ok") & ~F.lag("_ok").over(order), F.lit(True)).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_block", block).where("_ok")
    part = [*keys, "_block"]
    rows = ax.unrolled(track, rows, "x1d", part, "sample", "_u")
    rows = smooth_trace(rows, "_u", part, "sample", sigma_s / dt, out="_s")
    rows = rows.withColumn("_v", gradient(F.col("_s") * 100, F.col("t"), part, "sample"))
    rows = rows.withColumn("_dir", hysteresis(F.col("_v"), threshold_cm_s, part, "sample"))
    circuit = F.floor((F.col("_u") - track.start) / track.length) if track.ring else F.lit(0)
    rows = rows.withColumn("_turn", circuit)
    w = Window.partitionBy(*part).orderBy("sample")
    new = F.coalesce((F.lag("_dir").over(w) != F.col("_dir")) | (F.lag("_turn").over(w) != F.col("_turn")), F.lit(True)).cast("long")
    rows = rows.withColumn("_seg", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_dir <> 0")
    laps = rows.groupBy(*part, "_seg").agg(
        F.first("_dir").alias("_d"), F.min("sample").alias("start_sample"), (F.max("sample") + 1).alias("stop_sample"), F.min("t").alias("t_start"), F.max("t").alias("t_end"),
        F.min_by("x1d", "sample").alias("x_start"), F.max_by("x1d", "sample").alias("x_end"), ((F.max("_u") - F.min("_u")) / track.length).alias("coverage"),
    )
    duration = F.col("t_end") - F.col("t_start")
    kept = laps.where((duration >= min_s) & (duration <= max_s) & (F.col("coverage") >= min_coverage))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("start_sample")) - 1
    return kept.select(*keys, number.alias("lap"), F.when(F.col("_d") > 0, "pos").otherwise("neg").alias("direction"), "start_sample", "stop_sample", "t_start", "t_end", "x_start", "x_end", "coverage")


def lap_summary(laps: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, direction, n_laps, seconds, median_duration, median_coverage."""
    keys = keys or ["session"]
    d = F.col("t_end") - F.col("t_start")
    return laps.groupBy(*keys, "direction").agg(F.count(F.lit(1)).alias("n_laps"), F.sum(d).alias("seconds"), F.percentile(d, 0.5).alias("median_duration"), F.percentile("coverage", 0.5).alias("median_coverage"))


def principal_axis(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """keys, mx, my, ax, ay, variance: mean and first principal axis (unit, ax >= 0) of 2-D points, from the 2 x 2 covariance in closed form."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    c = rows.groupBy(*keys).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("_a"), F.covar_pop(x, y).alias("_b"), F.var_pop(y).alias("_c"))
    angle = 0.5 * F.atan2(2 * F.col("_b"), F.col("_a") - F.col("_c"))
    half, root = (F.col("_a") + F.col("_c")) / 2, F.sqrt(F.pow((F.col("_a") - F.col("_c")) / 2, 2) + F.col("_b") * F.col("_b"))
    return c.select(*keys, "mx", "my", F.cos(angle).alias("ax"), F.sin(angle).alias("ay"), (half + root).alias("variance"))


def linearize_2d(position: DataFrame, kind: str, keys: list[str] | None = None) -> DataFrame:
    """``position`` with x1d from (x, y): along the principal axis from its least projection (linear), or angle times median radius (circular).

    A linear axis points the way the given x1d grows, where that is known. What is known of a recording is one row, which goes
    to its samples where they lie: they are never brought together by recording.
    """
    keys = keys or ["session"]
    if kind == "linear":
        axis = principal_axis(position, "x", "y", keys)
        p = position.join(F.broadcast(axis), keys)
        p = p.withColumn("_p", (F.col("x") - F.col("mx")) * F.col("ax") + (F.col("y") - F.col("my")) * F.col("ay"))
        sign = p.groupBy(*keys).agg(F.when(F.covar_pop("_p", "x1d") < 0, -1).otherwise(1).alias("_sign"))
        p = p.join(F.broadcast(sign), keys).withColumn("_p", F.col("_p") * F.col("_sign"))
        low = p.groupBy(*keys).agg(F.min("_p").alias("_low"))
        return p.join(F.broadcast(low), keys).select(*(c for c in position.columns if c != "x1d"), (F.col("_p") - F.col("_low")).alias("x1d"))
    centre = position.groupBy(*keys).agg(((F.min("x") + F.max("x")) / 2).alias("_cx"), ((F.min("y") + F.max("y")) / 2).alias("_cy"))
    p = position.join(F.broadcast(centre), keys)
    p = p.withColumn("_r", F.hypot(F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy"))).withColumn("_a", F.pmod(F.atan2(F.col("y") - F.col("_cy"), F.col("x") - F.col("_cx")), F.lit(2 * math.pi)))
    radius = p.groupBy(*keys).agg(F.percentile("_r", 0.5).alias("_radius"))
    return p.join(F.broadcast(radius), keys).select(*(c for c in position.columns if c != "x1d"), (F.col("_a") * F.col("_radius")).alias("x1d"))


def coverage(position: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, n, share with a 1-D and with a 2-D position."""
    keys = keys or ["session"]
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return position.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x1d").isNotNull().cast("double")).alias("share_1d"), F.avg(both.cast("double")).alias("share_2d"))


def affine_fit(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """keys, slope, intercept, max_residual of the least-squares line; NULL without spread in x."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    line = rows.groupBy(*keys).agg(F.var_pop(x).alias("_v"), F.covar_pop(x, y).alias("_c"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    line = line.withColumn("slope", F.try_divide("_c", F.when(F.col("_v") > 0, F.col("_v")))).withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
    joined = rows.join(line, keys) if keys else rows.crossJoin(F.broadcast(line))
    rest: Column = F.abs(F.col(y) - F.col("slope") * F.col(x) - F.col("intercept"))
    return joined.groupBy(*keys, "slope", "intercept").agg(F.max(rest).alias("max_residual"))
