"""Positions along a line or around a ring, cut into equal bins: plain functions that build column expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Axis(NamedTuple):
    start: float
    length: float
    bins: int
    ring: bool  # the end is the start again


def cut(start: float, end: float, width: float, *, ring: bool) -> Axis:
    """Bins as near to ``width`` as a whole number of them allows (half to even, one at least)."""
    return Axis(start, end - start, max(1, round((end - start) / width)), ring)


def spanned(rows: DataFrame, width: float, *, ring: bool, x: str = "x1d") -> Axis:
    """The axis from the least to the largest position; ValueError if none is defined. One row comes to the driver."""
    least, most = rows.select(F.min(x), F.max(x)).first()
    if least is None:
        raise ValueError(f"no defined {x}")
    return cut(least, most, width, ring=ring)


def edges(axis: Axis) -> list[float]:
    """One more than bins; the last is exactly the end."""
    step = axis.length / axis.bins
    return [*(axis.start + k * step for k in range(axis.bins)), axis.start + axis.length]


def centre(axis: Axis, k: int) -> float:
    return axis.start + (k + 0.5) * axis.length / axis.bins


def bin_number(axis: Axis, x: Column) -> Column:
    """-1 for NULL and NaN. What lies outside goes around a ring, and to the nearest end bin of a line."""
    steps = F.floor((x - axis.start) * axis.bins / axis.length)
    placed = F.pmod(steps, F.lit(axis.bins)) if axis.ring else F.greatest(F.lit(0), F.least(steps, F.lit(axis.bins - 1)))
    return F.when(x.isNull() | F.isnan(x), F.lit(-1)).otherwise(placed.cast("int"))


def way(axis: Axis, to: Column, frm: Column) -> Column:
    """Signed way from ``frm`` to ``to``; on a ring the shorter one, half around counting as backwards."""
    straight = to - frm
    return F.pmod(straight + axis.length / 2, F.lit(axis.length)) - axis.length / 2 if axis.ring else straight


def brought_in(axis: Axis, x: Column) -> Column:
    """The same place of a ring within its first round; positions on a line stay."""
    return axis.start + F.pmod(x - axis.start, F.lit(axis.length)) if axis.ring else x


def unrolled(axis: Axis, rows: DataFrame, x: str, keys: list[str], order: str, out: str) -> DataFrame:
    """``rows`` with the way gone since the first sample of each stretch of defined samples, added to that sample's position."""
    by_time = Window.partitionBy(*keys).orderBy(order)
    so_far = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.lag(x).over(by_time)
    step = F.when(before.isNotNull(), way(axis, F.col(x), before))
    # Steps add up over the whole recording; what had added up where a stretch begins is taken off again.
    gone = rows.withColumn("_gone", F.sum(F.coalesce(step, F.lit(0.0))).over(so_far)).withColumn("_from", F.when(before.isNull() & F.col(x).isNotNull(), F.col(x) - F.col("_gone")))
    offset = F.last("_from", ignorenulls=True).over(so_far)
    return gone.withColumn(out, F.when(F.col(x).isNotNull(), F.col("_gone") + offset)).drop("_gone", "_from")
