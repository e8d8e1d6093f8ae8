"""Rank statistics and splits by group, as aggregations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .draws import hashed
from pyspark.sql.types import DoubleType


def finite(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(out, F.lit(False))


def rank_sums(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """keys, group, n, rank_sum, ties (sum of t^3 - t over tied values of both groups): average ranks.

    Equal values are counted before they are ranked, so the window runs over distinct values and a very
    common value is one row.
    """
    counted = df.where(finite(value)).groupBy(*keys, value, group).agg(F.count(F.lit(1)).alias("n"))
    same = counted.groupBy(*keys, value).agg(F.sum("n").alias("t"), F.collect_list(F.struct(group, "n")).alias("_g"))
    w = Window.partitionBy(*keys).orderBy(value)
    upto = F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = same.withColumn("_rank", upto - F.col("t") + (F.col("t") + 1) / 2).withColumn("_x", F.explode("_g"))
    t = F.col("t").cast("double")
    ties = same.groupBy(*keys).agg(F.sum(t * t * t - t).alias("ties"))
    out = ranked.groupBy(*keys, F.col(f"_x.{group}").alias(group)).agg(F.sum("_x.n").alias("n"), F.sum(F.col("_x.n") * F.col("_rank")).alias("rank_sum"))
    return out.join(ties, keys) if keys else out.crossJoin(F.broadcast(ties))  # one row


def mann_whitney(df: DataFrame, keys: list[str], group: str, value: str, first: object, second: object) -> DataFrame:
    """keys, n1, n2, u (of the first group), rank_biserial (2U/(n1 n2) - 1), z (tie and continuity corrected, two-sided)."""
    two = df.where(F.col(group).isin(first, second)).withColumn("_g", (F.col(group) == F.lit(first)).cast("int"))
    sums = rank_sums(two, keys, "_g", value)
    out = sums.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("_g") == 1, F.col("n"))), F.lit(0)).alias("n1"), F.coalesce(F.sum(F.when(F.col("_g") == 0, F.col("n"))), F.lit(0)).alias("n2"),
        F.sum(F.when(F.col("_g") == 1, F.col("rank_sum"))).alias("_r"), F.max("ties").alias("_ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    out = out.withColumn("u", F.col("_r") - n1 * (n1 + 1) / 2)
    var = n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("_ties"), n * (n - 1)))
    shift = F.abs(F.col("u") - n1 * n2 / 2) - 0.5
    z = F.when((n1 > 0) & (n2 > 0) & (var > 0), F.greatest(shift, F.lit(0.0)) / F.sqrt(var))
    return out.withColumn("rank_biserial", F.try_divide(2 * F.col("u"), n1 * n2) - 1).withColumn("z", z).drop("_r", "_ties")


def exact_u_p(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of U for two small samples without ties, by counting arrangements."""
    ways = np.zeros((n1 + 1, n1 * n2 + 1))
    ways[0, 0] = 1.0
    for j in range(1, n1 + n2 + 1):
        for i in range(min(j, n1), 0, -1):
            # the j-th value is the i-th of the first sample: it beats j - i values of the second
            beats = j - i
            if beats <= n2 and beats <= n1 * n2:
                ways[i, beats:] += ways[i - 1, : n1 * n2 + 1 - beats]
    count = ways[n1]
    p = count / count.sum()
    top = max(u, n1 * n2 - u)
    return float(min(1.0, 2 * p[int(math.ceil(top)) :].sum()))


@F.pandas_udf(DoubleType())
def mann_whitney_p(u: pd.Series, n1: pd.Series, n2: pd.Series, z: pd.Series, tied: pd.Series) -> pd.Series:
    """Exact if a sample has 8 values or fewer and nothing is tied, else by the normal approximation."""
    out = []
    for u_, a, b, z_, t in zip(u, n1, n2, z, tied, strict=True):
        if not a or not b or pd.isna(u_):
            out.append(None)
        elif min(a, b) <= 8 and not t:
            out.append(exact_u_p(float(u_), int(a), int(b)))
        else:
            out.append(1.0 if pd.isna(z_) else math.erfc(z_ / math.sqrt(2)))
    return pd.Series(out, dtype=float)


def ks_statistic(df: DataFrame, keys: list[str], group: str, value: str, first: object, second: object) -> DataFrame:
    """keys, n1, n2, d: the largest gap of two empirical distributions, by running counts over distinct values."""
    two = df.where(finite(value) & F.col(group).isin(first, second))
    is1 = (F.col(group) == F.lit(first)).cast("long")
    by = two.groupBy(*keys, value).agg(F.sum(is1).alias("_a"), F.sum(1 - is1).alias("_b"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    gap = F.abs(F.try_divide(F.sum("_a").over(upto), F.sum("_a").over(whole)) - F.try_divide(F.sum("_b").over(upto), F.sum("_b").over(whole)))
    return by.withColumn("_gap", gap).groupBy(*keys).agg(F.sum("_a").alias("n1"), F.sum("_b").alias("n2"), F.max("_gap").alias("d"))


def ks_p(d: float, n1: int, n2: int) -> float:
    """Asymptotic two-sided p of a two-sample Kolmogorov-Smirnov distance."""
    x = d * math.sqrt(n1 * n2 / (n1 + n2))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 0 else 1.0


def ks_tail(x: Column, terms: int = 100) -> Column:
    """The same p for a column of scaled distances, as a sum inside the row."""
    k = F.sequence(F.lit(1), F.lit(terms))
    total = F.aggregate(k, F.lit(0.0), lambda acc, j: acc + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * x * x))
    return F.when(x > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))).otherwise(F.lit(1.0))


def equal_halves(df: DataFrame, keys: list[str], value: str, id: str) -> DataFrame:
    """``df`` with half low or high by (value, id); of an odd number the middle one is left out."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_r", F.row_number().over(w.orderBy(value, id))).withColumn("_n", F.count(F.lit(1)).over(w))
    size = F.floor(F.col("_n") / 2)
    half = F.when(F.col("_r") <= size, "low").when(F.col("_r") > F.col("_n") - size, "high")
    return rows.withColumn("half", half).where("half is not null").drop("_r", "_n")


def random_halves(df: DataFrame, keys: list[str], id: str, seed: int) -> DataFrame:
    """Like equal_halves, by a seeded hash of the id: independent of row order and partitions."""
    return equal_halves(df.withColumn("_h", F.xxhash64(F.lit(seed), *keys, id)), keys, "_h", id).drop("_h")


def split_agreement(a: DataFrame, b: DataFrame, keys: list[str], id: str) -> DataFrame:
    """keys, n, agreement: the share of shared ids in the same half; both ways of naming halves count alike."""
    joined = a.select(*keys, id, F.col("half").alias("_a")).join(b.select(*keys, id, F.col("half").alias("_b")), [*keys, id])
    same = F.avg((F.col("_a") == F.col("_b")).cast("double"))
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), same.alias("_m")).select(*keys, "n", F.greatest("_m", 1 - F.col("_m")).alias("agreement"))


def empirical_p(df: DataFrame, keys: list[str], observed: str, draw: str) -> DataFrame:
    """keys, n, p = (1 + #|draw| >= |observed|) / (n + 1) over finite draws; NULL for an undefined observation."""
    rows = df.where(finite(draw))
    n_at_least = F.count_if(F.abs(draw) >= F.abs(observed))
    out = rows.groupBy(*keys, observed).agg(F.count(F.lit(1)).alias("n"), n_at_least.alias("_k"))
    return out.select(*keys, "n", F.when(finite(observed), (1 + F.col("_k")) / (1 + F.col("n"))).alias("p"))


def subsampled(df: DataFrame, keys: list[str], id: str, n: Column, draws: int, seed: int) -> DataFrame:
    """``draws`` seeded samples without replacement of ``n`` rows for each key: draw, rank and the row's columns."""
    fan = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    w = Window.partitionBy(*keys, "draw").orderBy(hashed(seed, "draw", id), id)
    return fan.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def exceedance_share(df: DataFrame, keys: list[str], group: str, value: str, first: object, second: object) -> DataFrame:
    """keys, share: over all pairs of a first and a second value, how often the first is at least as large; from ranks, not pairs."""
    mw = mann_whitney(df, keys, group, value, first, second)
    two = df.where(finite(value) & F.col(group).isin(first, second))
    is1 = (F.col(group) == F.lit(first)).cast("long")
    tied = two.groupBy(*keys, value).agg((F.sum(is1) * F.sum(1 - is1)).alias("_t")).groupBy(*keys).agg(F.sum("_t").alias("_t"))
    both = mw.join(tied, keys) if keys else mw.crossJoin(F.broadcast(tied))
    return both.select(*keys, F.try_divide(F.col("u") + F.col("_t") / 2, F.col("n1") * F.col("n2")).alias("share"))


# --- circular statistics --------------------------------------------------------------------------


def circular_mean(angle: Column) -> Column:
    """Aggregate: the mean direction in [0, 2 pi); NULL without rows."""
    return F.pmod(F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))), F.lit(2 * math.pi))


def circular_correlation(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, n, r (Jammalamadaka and SenGupta) of two angle columns; NULL under three rows or without spread."""
    rows = df.where(finite(a, b))
    means = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), circular_mean(F.col(a)).alias("_ma"), circular_mean(F.col(b)).alias("_mb"))
    joined = rows.select(*keys, a, b).join(means, keys) if keys else rows.select(a, b).crossJoin(F.broadcast(means))
    sa, sb = F.sin(F.col(a) - F.col("_ma")), F.sin(F.col(b) - F.col("_mb"))
    out = joined.groupBy(*keys, "n").agg(F.sum(sa * sb).alias("_ab"), F.sum(sa * sa).alias("_aa"), F.sum(sb * sb).alias("_bb"))
    return out.select(*keys, "n", F.when((F.col("n") >= 3) & (F.col("_aa") * F.col("_bb") > 0), F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb"))).alias("r"))


def guarded_corr(a: Column, b: Column) -> Column:
    """Aggregate: Pearson correlation, NULL instead of an error where a side has no spread."""
    n, sa, sb = F.count(F.lit(1)).cast("double"), F.var_pop(a), F.var_pop(b)
    return F.when((n > 1) & (sa > 0) & (sb > 0), F.covar_pop(a, b) / F.sqrt(sa * sb))


def circular_linear_correlation(df: DataFrame, keys: list[str], angle: str, value: str) -> DataFrame:
    """keys, n, r: Mardia's circular-linear correlation from three Pearson correlations; NULL under three rows."""
    rows = df.where(finite(angle, value)).select(*keys, F.sin(angle).alias("_s"), F.cos(angle).alias("_c"), F.col(value).alias("_x"))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), guarded_corr(F.col("_x"), F.col("_c")).alias("xc"), guarded_corr(F.col("_x"), F.col("_s")).alias("xs"), guarded_corr(F.col("_c"), F.col("_s")).alias("cs"))
    r2 = F.try_divide(F.col("xc") * F.col("xc") + F.col("xs") * F.col("xs") - 2 * F.col("xc") * F.col("xs") * F.col("cs"), 1 - F.col("cs") * F.col("cs"))
    return out.select(*keys, "n", F.when(F.col("n") >= 3, F.sqrt(F.greatest(r2, F.lit(0.0)))).alias("r"))
