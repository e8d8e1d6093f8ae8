"""Controls, baselines and choices: what a result is held against before it is believed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .draws import hashed
from .ranks import finite, mann_whitney, subsampled


def running_windows(laps: DataFrame, window_s: float, keys: list[str] | None = None) -> DataFrame:
    """keys, lap, k, start, end: whole windows laid end to end inside each lap."""
    keys = keys or ["session"]
    n = F.floor((F.col("t_end") - F.col("t_start")) / window_s + 1e-9).cast("int")
    rows = laps.withColumn("_n", n).where("_n > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.select(*keys, "lap", "k", (F.col("t_start") + F.col("k") * window_s).alias("start"), (F.col("t_start") + (F.col("k") + 1) * window_s).alias("end"))


def folded(df: DataFrame, keys: list[str], order: str, n_folds: int) -> DataFrame:
    """``df`` with fold 0..n_folds-1: contiguous blocks of the distinct values of ``order``, cut where whole parts of the list end."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_r", F.dense_rank().over(w.orderBy(order)) - 1).withColumn("_n", F.max("_r").over(w) + 1)
    # fold f holds ranks [floor(n f / k), floor(n (f + 1) / k)): its number is the last f whose beginning is not past the rank
    begins = F.transform(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda f: F.floor(F.col("_n") * f / n_folds))
    return rows.withColumn("fold", (F.size(F.filter(begins, lambda b: b <= F.col("_r"))) - 1).cast("int")).drop("_r", "_n")


def crossing_time(position: DataFrame, bin_width: float, keys: list[str] | None = None) -> DataFrame:
    """keys, seconds: how long the median running speed takes to cross one position bin; NULL without movement."""
    keys = keys or ["session"]
    w = Window.partitionBy(*keys).orderBy("t")
    speed = F.try_divide(F.abs(F.col("x1d") - F.lag("x1d").over(w)), F.col("t") - F.lag("t").over(w))
    m = position.withColumn("_v", speed).where("running").groupBy(*keys).agg(F.percentile("_v", 0.5).alias("_m"))
    return m.select(*keys, F.when(F.col("_m") > 0, bin_width / F.col("_m")).alias("seconds"))


def level_map(train: DataFrame, keys: list[str], level: str, x: str, period: float | None = None) -> DataFrame:
    """keys, level, mapped: mean position of each level, on a ring the mean direction."""
    from .states import state_positions

    return state_positions(train.withColumn("_w", F.lit(1.0)), keys, level, x, "_w", period=period).withColumnRenamed("position", "mapped")


def mapped_errors(test: DataFrame, mapping: DataFrame, keys: list[str], level: str, x: str, period: float | None = None) -> DataFrame:
    """keys, n, median_error of test positions against their level's mapped position; levels without a map are left out."""
    from .states import circular_distance

    joined = test.join(mapping, [*keys, level]).where(finite("mapped", x))
    d = F.abs(F.col("mapped") - F.col(x)) if period is None else circular_distance(F.col("mapped"), F.col(x), period)
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile(d, 0.5).alias("median_error"))


def chance_errors(test: DataFrame, mapping: DataFrame, keys: list[str], level: str, x: str, n: int, seed: int, period: float | None = None) -> DataFrame:
    """keys, median_error: the median over ``n`` seeded permutations of the mapping."""
    w = Window.partitionBy(*keys, "perm")
    fan = mapping.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    a = fan.withColumn("_r", F.row_number().over(w.orderBy(level)))
    b = fan.withColumn("_r", F.row_number().over(w.orderBy(hashed(seed, "perm", level), level))).select(*keys, "perm", "_r", F.col("mapped").alias("_other"))
    moved = a.join(b, [*keys, "perm", "_r"]).select(*keys, "perm", level, F.col("_other").alias("mapped"))
    each = mapped_errors(test.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), moved, [*keys, "perm"], level, x, period)
    return each.groupBy(*keys).agg(F.percentile("median_error", 0.5).alias("median_error"))


def phase_levels(bins: DataFrame, keys: list[str], bout: str, order: str, most: int = 12) -> DataFrame:
    """``bins`` with phase: the place in its bout, those from ``most`` - 1 on pooled."""
    place = F.row_number().over(Window.partitionBy(*keys, bout).orderBy(order)) - 1
    return bins.withColumn("phase", F.least(place, F.lit(most - 1)).cast("int"))


def quantile_levels(train: DataFrame, test: DataFrame, value: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Both with level 0..n-1, cut at quantiles of the training rows alone. One row of edges is joined to each."""
    edges = train.agg(F.percentile(value, F.array(*(F.lit(k / n) for k in range(1, n)))).alias("_e"))
    add = lambda df: df.crossJoin(F.broadcast(edges)).withColumn("level", F.size(F.filter("_e", lambda z: z <= F.col(value)))).drop("_e")
    return add(train), add(test)


def concentration_null(active: DataFrame, sizes: list[int], *, k: str = "n_active", draws: int = 400, seed: int = 0) -> DataFrame:
    """k, expected: mean share of the busiest group if k cells are drawn without replacement. Only distinct k are simulated.

    A draw is the k cells whose hashes of (seed, k, draw, cell) are the smallest; k beyond all cells takes all.
    """
    spark, total = active.sparkSession, sum(sizes)
    cells = spark.createDataFrame([(c, g) for c, g in enumerate(np.repeat(np.arange(len(sizes)), sizes).tolist())], "cell int, grp int")
    wanted = active.select(F.col(k).cast("int").alias(k)).distinct()
    fan = wanted.where(F.col(k) > 0).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).crossJoin(cells)
    place = F.row_number().over(Window.partitionBy(k, "draw").orderBy(hashed(seed, k, "draw", "cell"), "cell"))
    held = fan.withColumn("_r", place).where(F.col("_r") <= F.col(k)).groupBy(k, "draw", "grp").agg(F.count(F.lit(1)).alias("_n"))
    top = held.groupBy(k, "draw").agg((F.max("_n") / F.least(F.col(k), F.lit(total))).alias("_top"))
    return wanted.join(top.groupBy(k).agg(F.avg("_top").alias("expected")), k, "left")


def compare_epochs(scores: DataFrame, keys: list[str], value: str, first: str = "PRE", second: str = "POST", epoch: str = "epoch") -> DataFrame:
    """keys, n_first, n_second, medians, difference (second - first), rank_biserial and z of the second against the first."""
    two = scores.where(finite(value) & F.col(epoch).isin(first, second))
    med = lambda e: F.percentile(F.when(F.col(epoch) == e, F.col(value)), 0.5)
    m = two.groupBy(*keys).agg(med(first).alias("median_first"), med(second).alias("median_second"))
    mw = mann_whitney(two, keys, epoch, value, second, first)
    both = m.join(mw, keys) if keys else m.crossJoin(F.broadcast(mw))
    return both.select(*keys, F.col("n2").alias("n_first"), F.col("n1").alias("n_second"), "median_first", "median_second", (F.col("median_second") - F.col("median_first")).alias("difference"), "rank_biserial", "z")


def subsampled_differences(scores: DataFrame, keys: list[str], id: str, value: str, draws: int, seed: int, first: str = "PRE", second: str = "POST", epoch: str = "epoch") -> DataFrame:
    """keys, p5, p50, p95 of the difference of medians when the first epoch is sampled at the second's size."""
    rows = scores.where(finite(value) & F.col(epoch).isin(first, second))
    sizes = rows.where(F.col(epoch) == second).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile(value, 0.5).alias("_m"))
    a = rows.where(F.col(epoch) == first).join(sizes, keys)
    sample = subsampled(a, keys, id, F.col("_n"), draws, seed)
    each = sample.groupBy(*keys, "draw", "_m").agg(F.percentile(value, 0.5).alias("_f")).withColumn("_d", F.col("_m") - F.col("_f"))
    return each.groupBy(*keys).agg(F.percentile("_d", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("_p")).select(*keys, *(F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(("p5", "p50", "p95"))))


def summarise_fits(fits: DataFrame, keys: list[str], value: str, kind: str = "kind", size: str = "n_states") -> DataFrame:
    """keys, size, and for the kinds real and shuffled the median, quartiles, least and largest of the value."""
    aggs = []
    for k in ("real", "shuffled"):
        v = F.when(F.col(kind) == k, F.col(value))
        aggs += [F.percentile(v, 0.5).alias(f"{k}_median"), F.percentile(v, 0.25).alias(f"{k}_q1"), F.percentile(v, 0.75).alias(f"{k}_q3"), F.min(v).alias(f"{k}_least"), F.max(v).alias(f"{k}_most")]
    return fits.groupBy(*keys, size).agg(*aggs)


def choose_size(fits: DataFrame, keys: list[str], value: str, likelihood: str, kind: str = "kind", size: str = "n_states", fold: str = "fold") -> DataFrame:
    """keys, chosen (largest real median, the smallest size on ties), by_likelihood, fold_agreement (share of folds that choose alike), clear (its least real value is above the largest shuffled one)."""
    real = fits.where(F.col(kind) == "real")
    pick = lambda df, by, v, name: df.groupBy(*by, size).agg(F.percentile(v, 0.5).alias("_m")).groupBy(*by).agg(F.max_by(size, F.struct("_m", -F.col(size))).alias(name))
    best = pick(real, keys, value, "chosen").join(pick(real, keys, likelihood, "by_likelihood"), keys)
    folds = pick(real, [*keys, fold], value, "_f").join(best, keys).groupBy(*keys).agg(F.avg((F.col("_f") == F.col("chosen")).cast("double")).alias("fold_agreement"))
    at = summarise_fits(fits, keys, value, kind, size).select(*keys, F.col(size).alias("chosen"), (F.col("real_least") > F.col("shuffled_most")).alias("clear"))
    return best.join(folds, keys).join(at, [*keys, "chosen"], "left")


def classified(cells: DataFrame, *, min_spikes: int = 50, min_peak_hz: float = 1.0, alpha: float = 0.05, min_stability: float = 0.3) -> DataFrame:
    """``cells`` (n_spikes, peak_rate, p, n_fields, stability) with passes_core, passes_stability and is_place_cell; undefined values pass nothing."""
    core = (F.col("n_spikes") >= min_spikes) & (F.col("peak_rate") >= min_peak_hz) & (F.col("p") < alpha) & (F.col("n_fields") >= 1)
    stable = F.coalesce(F.col("stability") >= min_stability, F.lit(False))
    return cells.withColumn("passes_core", F.coalesce(core, F.lit(False))).withColumn("passes_stability", stable).withColumn("is_place_cell", F.col("passes_core") & F.col("passes_stability"))


def criteria_sweep(cells: DataFrame, variants: dict[str, dict], keys: list[str], cell: str = "cluster_id") -> DataFrame:
    """variant, keys, n_cells (distinct), n_pairs (cell and direction) under each set of criteria."""
    out = None
    for name, changed in variants.items():
        own = classified(cells, **changed).where("is_place_cell").groupBy(*keys).agg(F.countDistinct(cell).alias("n_cells"), F.count(F.lit(1)).alias("n_pairs")).select(F.lit(name).alias("variant"), *keys, "n_cells", "n_pairs")
        out = own if out is None else out.unionByName(own)
    return out


def decodable(events: DataFrame, n_cells: int, *, least: int = 5, share: float = 0.1, active: str = "n_active") -> DataFrame:
    """``events`` with decodable: enough active cells, in number and as a share."""
    return events.withColumn("decodable", (F.col(active) >= least) & (F.col(active) >= share * n_cells))


def event_structure(events: DataFrame, spikes: DataFrame, keys: list[str], bin_s: float, width: float = 60.0) -> DataFrame:
    """keys, event_id, n_bins (at least 1), n_used (bins with a spike), n_active, n_spikes in the closed [start, end]."""
    from .intervals import points_in_intervals

    n_bins = F.greatest(F.bround((F.col("end") - F.col("start")) / bin_s), F.lit(1)).cast("int")
    rows = events.withColumn("n_bins", n_bins)
    inside = points_in_intervals(spikes, rows, keys, closed="both", width=width)
    at = F.least(F.floor((F.col("t") - F.col("start")) / bin_s), F.col("n_bins") - 1)
    met = inside.groupBy(*keys, "event_id").agg(F.countDistinct(at).alias("n_used"), F.countDistinct("cluster_id").alias("n_active"), F.count(F.lit(1)).alias("n_spikes"))
    return rows.select(*keys, "event_id", "n_bins").join(met, [*keys, "event_id"], "left").fillna(0, ["n_used", "n_active", "n_spikes"])


def jittered(spikes: DataFrame, window_s: float, seed: int, keys: list[str]) -> DataFrame:
    """Spikes displaced by up to ``window_s`` either way, by a seeded hash of the spike: the same in any order."""
    h = F.pmod(F.xxhash64(F.lit(seed), *keys, "cluster_id", "t"), F.lit(1 << 53)).cast("double") / float(1 << 53)
    return spikes.withColumn("t", F.col("t") + (h * 2 - 1) * window_s)


def kmeans_levels(train: np.ndarray, test: np.ndarray, groups: int, seed: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Groups of the training rows (k-means++ start, seeded) and of the test rows by the nearest centre."""
    rng = np.random.default_rng(seed)
    centres = [train[rng.integers(len(train))].astype(float)]
    for _ in range(groups - 1):
        d = np.min([((train - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(train[rng.choice(len(train), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(train))].astype(float))
    c = np.array(centres)
    near = lambda x: ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    own = near(train)
    for _ in range(rounds):
        c = np.array([train[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(groups)])
        if (again := near(train)).tolist() == own.tolist():
            break
        own = again
    return near(train), near(test)
