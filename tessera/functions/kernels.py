"""Gaussian kernels, and smoothing of arrays and of traces."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised weights for offsets -r..r with r = int(truncate * sigma + 0.5)."""
    r = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)] if sigma > 0 else [1.0]
    return [w / sum(raw) for w in raw]


def smooth_array(values: Column, weights: list[float], mode: str, n: int) -> Column:
    """An ARRAY<DOUBLE> of ``n`` elements smoothed along itself, inside the JVM.

    mode: wrap (a ring), constant (zero outside), nearest (the end values go on).
    """
    r = len(weights) // 2
    out = []
    for b in range(n):
        by: dict[int, float] = {}
        for k, w in zip(range(-r, r + 1), weights, strict=True):
            at = (b + k) % n if mode == "wrap" else min(n - 1, max(0, b + k)) if mode == "nearest" else b + k
            if 0 <= at < n:
                by[at] = by.get(at, 0.0) + w
        out.append(F.array(*(F.lit(by.get(i, 0.0)) for i in range(n))))
    table = F.array(*out)
    return F.transform(table, lambda row: F.aggregate(F.zip_with(values, row, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x))


def smooth_trace(df: DataFrame, value: str, keys: list[str], i: str, sigma: float, *, truncate: float = 4.0, out: str = "smoothed") -> DataFrame:
    """Gaussian smoothing of a gap-free trace by index, the end values going on beyond both ends (``nearest``).

    For kernels up to some hundred samples: one window with lag and lead terms, all in generated code. The
    weight that falls outside goes to the first or last value of the trace.
    """
    weights = gaussian_weights(sigma, truncate)
    r = len(weights) // 2
    w = Window.partitionBy(*keys).orderBy(i)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.withColumn("_first", F.first(value).over(whole)).withColumn("_last", F.last(value).over(whole))
    total = F.col(value) * weights[r]
    for k in range(1, r + 1):
        total = total + (F.coalesce(F.lag(value, k).over(w), F.col("_first")) + F.coalesce(F.lead(value, k).over(w), F.col("_last"))) * weights[r + k]
    return rows.withColumn(out, total).drop("_first", "_last")


def smooth_trace_nan_aware(df: DataFrame, value: str, keys: list[str], i: str, sigma: float, out: str = "smoothed") -> DataFrame:
    """Like smooth_trace, but NULL samples neither count nor are filled: kernel sum of values over kernel sum of validity."""
    rows = df.withColumn("_v", F.coalesce(value, F.lit(0.0)).cast("double")).withColumn("_ok", F.col(value).isNotNull().cast("double"))
    rows = smooth_trace(smooth_trace(rows, "_v", keys, i, sigma, out="_sv"), "_ok", keys, i, sigma, out="_sok")
    return rows.withColumn(out, F.when(F.col(value).isNotNull(), F.try_divide("_sv", "_sok"))).drop("_v", "_ok", "_sv", "_sok")


def smooth_numpy(a: np.ndarray, sigma: float, mode: str = "nearest", truncate: float = 4.0, axis: int = -1) -> np.ndarray:
    """The same smoothing for kernels too wide for window terms; used inside grouped kernels."""
    weights = np.array(gaussian_weights(sigma, truncate))
    r = len(weights) // 2
    if not r:
        return np.asarray(a, float).copy()
    pad = {"nearest": "edge", "wrap": "wrap", "constant": "constant"}[mode]

    def one(x: np.ndarray) -> np.ndarray:
        x = np.pad(x, r, mode=pad)
        if len(weights) < 128:
            return np.convolve(x, weights, "valid")
        size = 1 << (len(x) + len(weights) - 2).bit_length()
        return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(weights, size), size)[len(weights) - 1 : len(x)]

    return np.apply_along_axis(one, axis, np.asarray(a, float))
