"""As-of joins: one shuffle and one sort of both sides together, never a nested loop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(queries: DataFrame, reference: DataFrame, keys: list[str], *, t: str = "t", values: list[str], direction: str = "nearest", tolerance: float | None = None, before: str | None = None, piece: float | None = None) -> DataFrame:
    """``queries`` with the ``values`` of one reference row each (NULL if none is near enough), and ref_t.

    direction: backward (ref <= query), forward (ref >= query), nearest (ties go to the earlier row), or
    both (values as ``name_prev`` and ``name_next``, with ``ref_t_prev`` and ``ref_t_next``). A reference row at the query's own time serves
    both directions. Rows of equal time are taken by the first value in ``values``, smallest first.
    With ``before`` (a whole-number column on both sides, e.g. a day), both sides are dealt by it as well;
    then matches stay inside one of its values. With ``piece`` a key's rows are dealt out by spans of so much time; the
    last and first reference row of each span, one row a span, serve the spans without one of their own. The
    result is the same for any width.
    """
    part = [*keys, *([before] if before else [])]
    dealt = [*part, *(["_piece"] if piece else [])]
    ref = F.struct(F.col(t).alias("t"), *(F.col(v) for v in values))
    names = [c for c in queries.columns if c not in (*part, t)]
    left = queries.select(*part, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_q") if names else F.struct(F.lit(1).alias("_one")).alias("_q"), F.lit(None).cast(reference.select(ref.alias("r")).schema["r"].dataType).alias("_r"), F.lit(None).cast(reference.select(F.col(values[0])).schema[0].dataType).alias("_v"))
    right = reference.select(*part, F.col(t).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_q"].dataType).alias("_q"), ref.alias("_r"), F.col(values[0]).alias("_v"))
    both = left.unionByName(right)
    if piece:
        both = both.withColumn("_piece", F.floor(F.col("_t") / piece).cast("long"))
    # Back: the latest time at or before, and of its rows the first; forward: the earliest time at or after.
    ahead = Window.partitionBy(*dealt).orderBy(F.col("_t").desc(), F.col("_side"), F.col("_v").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back_rows = Window.partitionBy(*dealt).orderBy("_t", "_side", F.col("_v").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.withColumn("_prev", F.last("_r", ignorenulls=True).over(back_rows))
    if direction != "backward":
        rows = rows.withColumn("_next", F.last("_r", ignorenulls=True).over(ahead))
    rows = rows.where("_side = 1")
    if piece:
        rows = _carried(rows, both, part, direction != "backward")

    def near(r: str) -> Column:
        gap = F.abs(F.col("_t") - F.col(f"{r}.t"))
        return F.when(gap <= tolerance, F.col(r)) if tolerance is not None else F.col(r)

    own = [*part, F.col("_t").alias(t), *(F.col(f"_q.{c}").alias(c) for c in names)]
    if direction == "both":
        return rows.withColumn("_prev", near("_prev")).withColumn("_next", near("_next")).select(*own, F.col("_prev.t").alias("ref_t_prev"), F.col("_next.t").alias("ref_t_next"), *(F.col(f"{s}.{v}").alias(f"{v}{s}") for v in values for s in ("_prev", "_next")))
    if direction == "nearest":
        chosen = F.when(F.col("_next.t") - F.col("_t") < F.col("_t") - F.col("_prev.t"), F.col("_next")).otherwise(F.coalesce("_prev", "_next"))
    else:
        chosen = F.col({"backward": "_prev", "forward": "_next"}[direction])
    rows = rows.withColumn("_hit", chosen).withColumn("_hit", near("_hit"))
    return rows.select(*own, F.col("_hit.t").alias("ref_t"), *(F.col(f"_hit.{v}").alias(v) for v in values))


def _carried(rows: DataFrame, both: DataFrame, part: list[str], ahead: bool) -> DataFrame:
    """``rows`` whose span has no reference row on a side get the nearest span's that has."""
    known = F.col("_side") == 0
    ends = both.groupBy(*part, "_piece").agg(F.min_by("_r", F.when(known, F.struct(-F.col("_t"), "_v"))).alias("_last"), F.min_by("_r", F.when(known, F.struct("_t", "_v"))).alias("_first"))
    w = Window.partitionBy(*part).orderBy("_piece")
    prev = F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    next_ = F.first("_first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    ends = ends.select(*(F.col(c).alias(f"_k{n}") for n, c in enumerate(part)), F.col("_piece").alias("_at"), prev.alias("_before"), next_.alias("_after"))
    same = reduce(lambda a, b: a & b, [F.col("_piece") == F.col("_at"), *(F.col(c).eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate(part))])
    rows = rows.join(ends, same).withColumn("_prev", F.coalesce("_prev", "_before"))
    return rows.withColumn("_next", F.coalesce("_next", "_after")) if ahead else rows


def interpolated(queries: DataFrame, reference: DataFrame, keys: list[str], value: str, t: str = "t") -> DataFrame:
    """``queries`` with ``value`` interpolated linearly between its neighbours, flat beyond both ends; NULL if a neighbour's value is NULL."""
    near = asof(queries, reference, keys, t=t, values=[value], direction="both")
    a, b, lo, hi = F.col(f"{value}_prev"), F.col(f"{value}_next"), F.col("ref_t_prev"), F.col("ref_t_next")
    inner = a + (b - a) * F.try_divide(F.col(t) - lo, hi - lo)
    at = F.when(lo.isNull(), b).when(hi.isNull() | (lo == hi), a).otherwise(inner)
    return near.select(*queries.columns, at.alias(value))
