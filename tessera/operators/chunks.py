"""Window operators over very long traces, in chunks of samples that are dealt out over tasks.

Samples carry a whole-number index that grows by one within the keys; rows without one leave. Results
don't depend on the size of a chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_halo(trace: DataFrame, i: str, chunk: int, halo: int) -> DataFrame:
    """Every sample in its own chunk (core) and in those whose halo it lies in. A chunk beyond the trace's ends can be all halo."""
    at, own = F.col(i), F.floor(F.col(i) / chunk).cast("long")
    near = F.sequence(F.floor((at - halo) / chunk).cast("long"), F.floor((at + halo) / chunk).cast("long"))
    return trace.withColumn("_own", own).withColumn("_chunk", F.explode(near)).withColumn("_core", F.col("_own") == F.col("_chunk")).drop("_own")


def over_chunks(df: DataFrame, op: Callable[[DataFrame, list[str]], DataFrame], keys: list[str], i: str, chunk: int, halo: int) -> DataFrame:
    """``op(rows, keys)`` for each chunk, where a sample's result depends on at most ``halo`` samples on either side of it.

    op keeps the rows it gets and adds columns. Shuffled rows grow by 2 * halo / chunk.
    """
    return op(with_halo(df, i, chunk, halo), [*keys, "_chunk"]).where("_core").drop("_chunk", "_core")


def latched(df: DataFrame, signal: Column, threshold: float, keys: list[str], i: str, chunk: int, out: str) -> DataFrame:
    """The hysteresis latch, which has no bounded halo: inside chunks first, then one row a chunk carries the last state on."""
    rows = df.where(F.col(i).isNotNull()).withColumn("_chunk", F.floor(F.col(i) / chunk).cast("long"))
    rows = rows.withColumn("_mark", F.when(signal > threshold, 1).when(signal < -threshold, -1))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(i).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.groupBy(*keys, "_chunk").agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col(i))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*(F.col(k).alias(f"_{n}") for n, k in enumerate(keys)), F.col("_chunk").alias("_at"), F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    same = reduce(lambda a, b: a & b, [F.col("_chunk") == F.col("_at"), *(F.col(k).eqNullSafe(F.col(f"_{n}")) for n, k in enumerate(keys))])
    held = rows.withColumn("_held", F.last("_mark", ignorenulls=True).over(inside)).join(carried, same)
    return held.withColumn(out, F.coalesce("_held", "_carried", F.lit(0))).select(*df.columns, out)


def running_sum(df: DataFrame, value: str, keys: list[str], order: list[str], piece: float, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row, in ``order``, whose first column is a time that deals rows out by spans of ``piece``.

    Each span is summed by itself; one row a span carries the sum of all before it. NULL values add nothing; rows without a time leave.
    """
    rows = df.where(F.col(order[0]).isNotNull()).withColumn("_piece", F.floor(F.col(order[0]) / piece).cast("long")).withColumn("_x", F.coalesce(value, F.lit(0)))
    inside = Window.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_piece").agg(F.sum("_x").alias("_total"))
    carried = totals.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.col("_piece").alias("_at"), F.coalesce(F.sum("_total").over(upto), F.lit(0)).alias("_carried"))
    same = reduce(lambda a, b: a & b, [F.col("_piece") == F.col("_at"), *(F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys))])
    return rows.withColumn("_own", F.sum("_x").over(inside)).join(carried, same).withColumn(out, F.col("_own") + F.col("_carried")).select(*df.columns, out)
