"""Bayesian decoding with Poisson rates: a long form that any SQL engine has, and an Arrow kernel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .draws import hashed

FLOOR_HZ = 0.01


def leave_one_group_out(totals: DataFrame, keys: list[str], group: str, values: list[str]) -> DataFrame:
    """totals (keys, group, values) to the sums over all OTHER groups of a key: total - own, exact for sums.

    Smoothing and division come after this, as both are of the sums.
    """
    w = Window.partitionBy(*keys)
    return totals.select(*keys, group, *((F.sum(v).over(w) - F.col(v)).alias(v) for v in values))


def log_posterior(counts: DataFrame, tuning: DataFrame, keys: list[str], template: list[str], dt: float, *, cell: str = "cell", bin: str = "bin", floor_hz: float = FLOOR_HZ, prior: DataFrame | None = None) -> DataFrame:
    """keys, template, bin, lp: normalised log posterior over bins of each time bin with at least one spike.

    counts: keys, template, cell, n. tuning: template, cell, bin, rate. Silent cells count through the
    penalty dt * sum of rates, which is one number for each template and bin. prior: bin, log_prior.
    """
    rate = F.greatest(F.coalesce(F.when(~F.isnan("rate"), F.col("rate")), F.lit(floor_hz)), F.lit(floor_hz))
    floored = tuning.withColumn("_f", rate)
    penalty = floored.groupBy(*template, bin).agg(F.sum(F.col("_f") * dt).alias("_p"))
    logs = floored.select(*template, cell, bin, F.log("_f").alias("_l"))
    gained = counts.where("n > 0").join(logs, [*template, cell]).groupBy(*keys, *template, bin).agg(F.sum(F.col("n") * F.col("_l")).alias("_g"))
    raw = gained.join(penalty, [*template, bin]).withColumn("_x", F.col("_g") - F.col("_p"))
    if prior is not None:
        raw = raw.join(prior, bin).withColumn("_x", F.col("_x") + F.col("log_prior"))  # as many rows as bins
    w = Window.partitionBy(*keys, *template)
    top = raw.withColumn("_m", F.max("_x").over(w))
    return top.withColumn("_s", F.sum(F.exp(F.col("_x") - F.col("_m"))).over(w)).select(*keys, *template, bin, (F.col("_x") - F.col("_m") - F.log("_s")).alias("lp"))


def posterior_mode(posterior: DataFrame, keys: list[str], bin: str = "bin") -> DataFrame:
    """keys, bin of the largest log posterior, the first of equal ones."""
    return posterior.groupBy(*keys).agg(F.max_by(bin, F.struct("lp", -F.col(bin))).alias("decoded"))


def posterior_arrays(counts: DataFrame, tuning: np.ndarray, dt: float, *, floor_hz: float = FLOOR_HZ) -> DataFrame:
    """``counts`` (with n: ARRAY<DOUBLE> over cells) with posterior: ARRAY<DOUBLE> over bins, by one matrix product a batch.

    tuning: (cells, bins). It is as large as one template, whatever the data.
    """
    rates = np.maximum(np.nan_to_num(tuning, nan=floor_hz), floor_hz)
    logs, cost = np.log(rates), dt * rates.sum(axis=0)
    schema = counts.drop("posterior").select("*", F.array(F.lit(0.0)).alias("posterior")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["n"].to_numpy()).astype(float) @ logs - cost
                x = np.exp(x - x.max(axis=1, keepdims=True))
                yield pdf.assign(posterior=list(x / x.sum(axis=1, keepdims=True)))

    return counts.drop("posterior").mapInPandas(run, schema)


def error_summary(errors: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    """keys, n, n_decodable, median, mean, p10..p90 (linear interpolation) and the undecodable share; NULL errors are undecodable."""
    return errors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(error).alias("n_decodable"), F.avg(error).alias("mean"), F.percentile(error, F.array(*(F.lit(q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)))).alias("_p"), F.avg(F.col(error).isNull().cast("double")).alias("undecodable"),
    ).select(*keys, "n", "n_decodable", "mean", *(F.get("_p", F.lit(i)).alias(f"p{q}") for i, q in enumerate((10, 25, 50, 75, 90))), "undecodable")


def confusion_matrix(pairs: DataFrame, true: str, decoded: str, keys: list[str] | None = None, normalize: bool = True) -> DataFrame:
    """keys, true, decoded, n and its share of the row; only cells that occur."""
    keys = keys or []
    counts = pairs.where(F.col(true).isNotNull() & F.col(decoded).isNotNull()).groupBy(*keys, true, decoded).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, true))) if normalize else counts


def error_by_position(errors: DataFrame, x: str, lo: float, hi: float, groups: int = 8, error: str = "error") -> DataFrame:
    """position_group, n, median error in equal position groups; ends clip."""
    at = F.least(F.greatest(F.floor((F.col(x) - lo) / (hi - lo) * groups), F.lit(0)), F.lit(groups - 1)).cast("int")
    return errors.where(F.col(x).isNotNull()).groupBy(at.alias("position_group")).agg(F.count(error).alias("n"), F.percentile(error, 0.5).alias("median"))


def permuted_cells(tuning: DataFrame, permutation: DataFrame, cell: str = "cell") -> DataFrame:
    """tuning under permuted identities: permutation (perm_id, cell, takes) gives each cell another one's rates."""
    return permutation.join(tuning.withColumnRenamed(cell, "takes"), "takes").drop("takes")


def permutations(cells: list[int], n: int, seed: int) -> list[tuple[int, int, int]]:
    """(perm_id, cell, takes) rows of ``n`` seeded permutations; a cell list is small."""
    rng = np.random.default_rng(seed)
    return [(k, int(c), int(t)) for k in range(n) for c, t in zip(cells, rng.permutation(cells), strict=True)]


def ensembles(cells: list[int], sizes: list[int], draws: int, seed: int) -> list[tuple[int, int, int]]:
    """(size, draw, cell) rows of seeded random subsets."""
    rng = np.random.default_rng(seed)
    return [(s, d, int(c)) for s in sizes if s <= len(cells) for d in range(draws) for c in rng.choice(cells, s, replace=False)]


def drawn_ensembles(cells: DataFrame, sizes: list[int], draws: int, seed: int, cell: str = "cell") -> DataFrame:
    """size, draw, cell: random subsets of the cells by hashes of (seed, size, draw, cell); a size of all cells or more is drawn once, whole."""
    n = cells.agg(F.count(F.lit(1)).alias("_n"))
    fan = cells.select(cell).crossJoin(n).withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).withColumn("size", F.least("size", "_n").cast("int")).distinct()
    fan = fan.withColumn("draw", F.explode(F.sequence(F.lit(0), F.when(F.col("size") < F.col("_n"), draws - 1).otherwise(0))))
    w = Window.partitionBy("size", "draw").orderBy(hashed(seed, "size", "draw", cell), cell)
    return fan.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("size")).select("size", "draw", cell)


def drawn_permutations(cells: DataFrame, n: int, seed: int, cell: str = "cell") -> DataFrame:
    """perm_id, cell, takes: in each of ``n`` permutations every cell takes another one's place, by hashes of (seed, perm_id, cell)."""
    fan = cells.select(cell).withColumn("perm_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    w = Window.partitionBy("perm_id")
    a = fan.withColumn("_r", F.row_number().over(w.orderBy(cell)))
    b = fan.withColumn("_r", F.row_number().over(w.orderBy(hashed(seed, "perm_id", cell), cell))).select("perm_id", "_r", F.col(cell).alias("takes"))
    return a.join(b, ["perm_id", "_r"]).select("perm_id", cell, "takes")


def interpolate_flag(column: Column) -> Column:
    """Undecodable bins (no spikes) stay in the result with a NULL position."""
    return F.when(column > 0, F.lit(True)).otherwise(F.lit(False))
