"""Exact percentiles of keys of any size, by histograms that are refined only where a wanted rank lies.

Each pass counts a key's rows by equal parts of a range; the part that holds a rank is the next range. Counts are
aggregated before they are shuffled, and a range that holds few rows is sorted at the end. So no key's rows come
together in one task, however many it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

PARTS = 1024


def _part(value: Column, lo: Column, hi: Column, parts: int) -> Column:
    """Number of the part of [lo, hi] that a value lies in; it never falls as the value grows. Halves keep the range finite."""
    share = (value / 2 - lo / 2) / (hi / 2 - lo / 2)
    return F.when(hi > lo, F.least(F.floor(share * parts), F.lit(parts - 1)).cast("int")).otherwise(0)


def selected(df: DataFrame, ranks: DataFrame, key: str, value: str, *, parts: int = PARTS, few: int = 10_000) -> DataFrame:
    """key, rank, value: the value at each rank (from 0) of its key's values in order.

    df: key, value, finite and not NULL. ranks: key, rank, lo, hi, n, the key's least and largest value and size.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_v"))
    at = written(ranks.select(F.col(key).alias("_key"), "rank", F.lit(0).cast("long").alias("below"), "lo", "hi", F.col("n").alias("size")), "ranks")
    found = None
    while True:
        same = (F.col("lo") == F.col("hi")) | (F.col("size") <= few)
        done, going = at.where(same), at.where(~same)
        found = done if found is None else found.unionByName(done)
        if going.isEmpty():
            break
        ranges = going.select("_key", "lo", "hi").distinct()
        inside = rows.join(ranges, "_key").where(F.col("_v").between(F.col("lo"), F.col("hi")))
        counts = inside.groupBy("_key", "lo", "hi", _part(F.col("_v"), F.col("lo"), F.col("hi"), parts).alias("_part")).agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("a"), F.max("_v").alias("z"))
        upto = Window.partitionBy("_key", "lo", "hi").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("c").over(upto), F.lit(0).cast("long")))
        place = F.col("rank") - F.col("below") - F.col("before")
        next_ = going.join(counts, ["_key", "lo", "hi"]).where((place >= 0) & (place < F.col("c")))
        at = written(next_.select("_key", "rank", (F.col("below") + F.col("before")).alias("below"), F.col("a").alias("lo"), F.col("z").alias("hi"), F.col("c").alias("size")), "ranks")
    equal = found.where("lo = hi").select("_key", "rank", F.col("lo").alias("_v"))
    spans = found.where("lo < hi").select("_key", "lo", "hi", "below").distinct()
    order = Window.partitionBy("_key", "lo", "hi").orderBy("_v")
    small = rows.join(spans, "_key").where(F.col("_v").between(F.col("lo"), F.col("hi"))).withColumn("rank", F.col("below") + F.row_number().over(order) - 1)
    few_ = small.join(found.where("lo < hi").select("_key", "lo", "hi", "rank"), ["_key", "lo", "hi", "rank"]).select("_key", "rank", "_v")
    return equal.unionByName(few_).select(F.col("_key").alias(key), "rank", F.col("_v").alias(value))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], *, parts: int = PARTS, few: int = 10_000) -> DataFrame:
    """keys, n, percentiles ARRAY<DOUBLE>: linear between the two ranks next to share * (n - 1), as ``percentile`` has it.

    NULL, NaN and infinite values take no part; a key without any other has no row. NULL keys are keys.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(F.struct(*(F.col(k) for k in keys), F.lit(0).alias("_0")).alias("_k"), v.alias("_v"))
    ends = written(rows.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")), "ends")
    place = ends.select("_k", "n", "lo", "hi", F.posexplode(F.array(*map(F.lit, shares))).alias("q", "share")).withColumn("at", F.col("share") * (F.col("n") - 1))
    wanted = place.select("_k", "n", "lo", "hi", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    values = selected(rows, wanted, "_k", "_v", parts=parts, few=few)
    low, high = (values.select("_k", F.col("rank").alias(f"_{n}"), F.col("_v").alias(n)) for n in ("low", "high"))
    both = place.withColumn("_low", F.floor("at")).withColumn("_high", F.ceil("at")).join(low, ["_k", "_low"]).join(high, ["_k", "_high"])
    share = F.col("at") - F.col("_low")
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - share) * F.col("low") + share * F.col("high"))
    out = both.groupBy("_k", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", between.alias("v")))), lambda x: x["v"]).alias("percentiles"))
    return out.select(*(F.col(f"_k.{k}").alias(k) for k in keys), "n", "percentiles")
