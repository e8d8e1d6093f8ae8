"""Rate maps over position bins: occupancy, counts, information, fields, stability and shuffles.

Counts are aggregated to (cell, bin) before anything else; from there a cell is one row with arrays, and
smoothing, information and fields are array expressions without further shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import gaussian_weights, smooth_array, smooth_numpy
from .asof import asof


def select_running_samples(samples: DataFrame, laps: DataFrame, *, direction: str | None = None) -> DataFrame:
    """session, sample, t, bin, lap, slot: running samples inside laps, numbered in compressed running time.

    samples: session, sample, t, bin (-1: undefined), running. laps: session, lap, direction, start_sample,
    stop_sample (half-open). direction None keeps both.
    """
    from .intervals import points_in_intervals

    chosen = laps.where(F.col("direction") == direction) if direction else laps
    inside = points_in_intervals(samples.where("running and bin >= 0"), chosen, ["session"], t="sample", start="start_sample", end="stop_sample", width=1000.0)
    slot = F.row_number().over(Window.partitionBy("session").orderBy("sample")) - 1
    return inside.select("session", "sample", "t", "bin", "lap", slot.cast("long").alias("slot"))


def spike_slots(spikes: DataFrame, position: DataFrame, running: DataFrame) -> DataFrame:
    """session, cluster_id, slot, bin, lap of each spike whose nearest position sample is a running one."""
    near = asof(spikes, position, ["session"], values=["sample"])
    return near.join(running.select("session", "sample", "slot", "bin", "lap"), ["session", "sample"])


def binned_array(df: DataFrame, keys: list[str], bin: str, n_bins: int, value: Column | None = None, out: str = "counts") -> DataFrame:
    """keys, out: ARRAY<DOUBLE> of the rows (or summed value) in each bin, zeros included."""
    by = df.groupBy(*keys, bin).agg((F.count(F.lit(1)) if value is None else F.sum(value)).cast("double").alias("_n"))
    entries = F.map_from_entries(F.collect_list(F.struct(F.col(bin).cast("int"), "_n")))
    return by.groupBy(*keys).agg(entries.alias("_m")).select(*keys, F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda b: F.coalesce(F.try_element_at("_m", b), F.lit(0.0))).alias(out))


def rate_maps(counts: DataFrame, occupancy: DataFrame, keys: list[str], *, n_bins: int, sigma: float = 1.0, circular: bool = True, min_occupancy: float = 0.1, truncate: float = 4.0) -> DataFrame:
    """counts and occupancy (ARRAY<DOUBLE>, joined on ``keys``; none: one row for all) to rate and valid arrays.

    rate = smoothed counts / smoothed occupancy, NULL where the raw occupancy is under the floor.
    """
    weights, mode = gaussian_weights(sigma, truncate), "wrap" if circular else "constant"
    both = counts.join(occupancy, keys) if keys else counts.crossJoin(F.broadcast(occupancy))  # one row
    both = both.withColumn("_c", smooth_array(F.col("counts"), weights, mode, n_bins)).withColumn("_o", smooth_array(F.col("occupancy"), weights, mode, n_bins))
    rate = F.transform(F.arrays_zip("_c", "_o", "occupancy"), lambda x: F.when(x["occupancy"] >= min_occupancy, F.try_divide(x["_c"], x["_o"])))
    return both.withColumn("rate", rate).drop("_c", "_o")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. The optimiser would otherwise write it out at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def skaggs_information(rate: Column, occupancy: Column) -> Column:
    """Bits per spike: sum p r/m log2(r/m) over bins with a rate, p the share of their occupancy, m the mean rate; NULL if silent."""

    def of(x: Column) -> Column:
        held = F.filter(x, lambda z: z["r"].isNotNull())
        time = F.aggregate(held, F.lit(0.0), lambda a, z: a + z["o"])
        mass = F.aggregate(held, F.lit(0.0), lambda a, z: a + z["r"] * z["o"])
        bits = lambda t, m: F.aggregate(held, F.lit(0.0), lambda a, z: a + F.when(z["r"] > 0, z["o"] / t * (z["r"] / m) * F.log2(z["r"] / m)).otherwise(F.lit(0.0)))
        return let(F.struct(time.alias("t"), F.try_divide(mass, time).alias("m")), lambda s: F.when(s["m"] > 0, bits(s["t"], s["m"])))

    return let(F.zip_with(rate, occupancy, lambda r, o: F.struct(r.alias("r"), o.alias("o"))), of)


def mean_rate(rate: Column, occupancy: Column) -> Column:
    pairs = F.filter(F.zip_with(rate, occupancy, lambda r, o: F.struct(r.alias("r"), o.alias("o"))), lambda z: z["r"].isNotNull())
    return let(pairs, lambda x: F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, z: a + z["r"] * z["o"]), F.aggregate(x, F.lit(0.0), lambda a, z: a + z["o"])))


def peak_rate(rate: Column) -> Column:
    return F.array_max(rate)


def peak_bin(rate: Column) -> Column:
    """The first bin of the largest rate, from 0; NULL without any rate."""
    at = lambda x: F.array_position(F.transform(x, lambda r: F.coalesce(r, F.lit(float("-inf")))), F.array_max(x))
    return let(rate, lambda x: F.when(F.array_max(x).isNotNull(), (at(x) - 1).cast("int")))


def find_fields(rate: Column, n_bins: int, *, threshold_frac: float = 0.2, min_bins: float = 1, max_bins: float = 1e9, circular: bool = True) -> Column:
    """ARRAY<STRUCT<first, n>> of runs of at least the fraction of the peak whose width is in range.

    On a ring a run may pass from the last bin to the first; if all bins are high there is one run from bin 0.
    """

    def high(x: Column) -> Column:
        return let(F.array_max(x), lambda top: F.transform(x, lambda r: F.coalesce((r >= top * threshold_frac) & (top > 0), F.lit(False))))

    def edges(on: Column, step: int) -> Column:
        def edge(x: Column, b: Column) -> Column:
            near = F.element_at(on, F.pmod(b + step, F.lit(n_bins)).cast("int") + 1)
            if not circular:
                near = F.when((b + step < 0) | (b + step >= n_bins), F.lit(False)).otherwise(near)
            return F.when(x & ~near, b)

        return F.filter(F.transform(on, edge), lambda b: b.isNotNull())

    def runs(on: Column) -> Column:
        found = let(F.struct(edges(on, -1).alias("s"), edges(on, 1).alias("e")), lambda z: F.transform(z["s"], lambda s: F.struct(s.alias("first"), (F.array_min(F.transform(z["e"], lambda e: F.pmod(e - s, F.lit(n_bins)))) + 1).alias("n"))))
        every = F.array(F.struct(F.lit(0).alias("first"), F.lit(n_bins).alias("n")))
        return F.when(F.forall(on, lambda x: x), every).otherwise(found) if circular else found

    return let(let(rate, high), lambda on: F.filter(runs(on), lambda x: (x["n"] >= min_bins) & (x["n"] <= max_bins)))


def pearson(a: Column, b: Column, least: int = 3) -> Column:
    """Correlation of two arrays over places where both are defined; NULL under ``least`` places or without spread."""
    mean = lambda x, c: F.try_divide(F.aggregate(x, F.lit(0.0), lambda s, z: s + z[c]), F.size(x).cast("double"))

    def of(x: Column) -> Column:
        part = lambda m, c, d: F.aggregate(x, F.lit(0.0), lambda s, z: s + (z[c] - m[c]) * (z[d] - m[d]))
        sums = lambda m: F.struct(part(m, "a", "b").alias("ab"), part(m, "a", "a").alias("aa"), part(m, "b", "b").alias("bb"))
        return let(F.struct(mean(x, "a").alias("a"), mean(x, "b").alias("b")), lambda m: let(sums(m), lambda s: F.when((F.size(x) >= least) & (s["aa"] > 0) & (s["bb"] > 0), s["ab"] / F.sqrt(s["aa"] * s["bb"]))))

    return let(F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b"))), lambda z: z["a"].isNotNull() & z["b"].isNotNull()), of)


def split_halves(spikes: DataFrame, keys: list[str], lap: str = "lap") -> DataFrame:
    """``spikes`` with half 0 or 1: the parity of each lap's rank among the laps present."""
    return spikes.withColumn("half", (F.dense_rank().over(Window.partitionBy(*keys).orderBy(lap)) - 1) % 2)


def laps_active(spikes: DataFrame, keys: list[str], lap: str = "lap") -> DataFrame:
    return spikes.groupBy(*keys).agg(F.countDistinct(lap).alias("n_laps"))


def rolled(values: Column, shift: Column, n: int) -> Column:
    """values[(b - shift) mod n]: what lies in bin b after everything moved up by ``shift``."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.element_at(values, F.pmod(b - shift, F.lit(n)).cast("int") + 1))


def shifted_spikes(slots: DataFrame, running: DataFrame, shifts: DataFrame, keys: list[str]) -> DataFrame:
    """Spikes moved by each shift in compressed running time and put into the bins of the slots they land on.

    shifts: keys (or none), shuffle_id, shift. Slots wrap round at the number of running samples; counts by
    (key, shuffle_id, bin) follow by one aggregation, before which nothing is sorted.
    """
    size = running.groupBy("session").agg((F.max("slot") + 1).alias("n_slots"))
    fan = slots.join(size, "session").join(shifts, [k for k in keys if k in shifts.columns]) if any(k in shifts.columns for k in keys) else slots.join(size, "session").crossJoin(shifts)
    moved = fan.withColumn("slot", F.pmod(F.col("slot") + F.col("shift"), F.col("n_slots")))
    return moved.drop("bin", "lap").join(running.select("session", "slot", "bin", "lap"), ["session", "slot"])


def seeded_shifts(n_shuffles: int, *, seed: int = 0, least: int = 1) -> Callable[[tuple, int], np.ndarray]:
    """Shifts from ``least`` to n - least - 1 of n slots, by the MD5 of seed, key and number: the same wherever a cell is worked on."""

    def of(key: tuple, n: int) -> np.ndarray:
        hashed = (hashlib.md5(":".join(map(str, (seed, *key, k))).encode()).hexdigest()[:12] for k in range(1, n_shuffles + 1))
        return np.array([least + int(h, 16) % max(n - 2 * least, 1) for h in hashed], np.int64)

    return of


def multiple_shifts(n_shuffles: int, step: int) -> Callable[[tuple, int], np.ndarray]:
    return lambda _, n: np.arange(1, n_shuffles + 1, dtype=np.int64) * step % n


def shifted_counts(slots: np.ndarray, k: np.ndarray, bins: np.ndarray, shifts: np.ndarray, n_bins: int, masks: np.ndarray | None = None) -> np.ndarray:
    """(shifts, bins): what falls in each bin once the counts k of these slots are moved on by each shift, round the recording.

    The counts of all shifts are one circular correlation of the slots' counts with each bin's mask (``masks``: its
    transforms). A few spikes under few shifts are looked up instead, which is exact as well: counts are whole.
    """
    n = len(bins)
    if len(slots) * len(shifts) <= 4 * n_bins * n:
        out = np.zeros((len(shifts), n_bins))
        most = max(1, (1 << 22) // max(1, len(slots)))
        for at in range(0, len(shifts), most):
            part = shifts[at : at + most]
            place = bins[(slots + part[:, None]) % n] + n_bins * np.arange(len(part))[:, None]
            out[at : at + most] = np.bincount(place.ravel(), np.broadcast_to(k, place.shape).ravel(), len(part) * n_bins).reshape(-1, n_bins)
        return out
    own = np.conj(np.fft.rfft(np.bincount(slots, k, n)))
    each = (masks[b] if masks is not None else np.fft.rfft(bins == b) for b in range(n_bins))
    return np.rint(np.stack([np.fft.irfft(own * m, n)[shifts] for m in each], axis=1))


def information(rates: np.ndarray, occupancy: np.ndarray) -> np.ndarray:
    """Skaggs information of each row of rates (NaN: no rate); NaN for a silent row."""
    o = np.where(np.isnan(rates), 0.0, occupancy)
    r = np.nan_to_num(rates)
    with np.errstate(all="ignore"):
        p = o / o.sum(axis=-1, keepdims=True)
        m = (p * r).sum(axis=-1, keepdims=True)
        x = r / m
        bits = (p * np.where(x > 0, x * np.log2(np.where(x > 0, x, 1.0)), 0.0)).sum(axis=-1)
    return np.where(m[..., 0] > 0, bits, np.nan)


def shift_null(cells: DataFrame, running: DataFrame, keys: list[str], shifts: Callable[[tuple, int], np.ndarray], *, n_bins: int, slot_s: float = 1.0, sigma: float = 0.0, circular: bool = True, min_occupancy: float = 0.0, digits: int = 7, cells_a_task: int = 64) -> DataFrame:
    """session, keys, n_spikes, info, null_mean, null_sd, info_z, n_null, n_at_least, p: information against circular shifts.

    cells: session, keys, slot, k (spikes in the slot; slots may repeat). running: session, slot (0, 1, ... in compressed running
    time), bin. shifts: from (key, number of slots) to the shifts. Rates are smoothed counts over smoothed occupancy, none where the
    raw occupancy is under its floor. Information is rounded to ``digits``, so that shifts equal but for rounding tie.
    A session's cells are dealt to tasks by ``cells_a_task``, each with the session's bins; spikes are not multiplied.
    Under two slots there are no shifts: the null is NULL and p is 1. Sessions without running slots give no rows.
    """
    smooth = smooth_numpy(np.eye(n_bins), sigma, "wrap" if circular else "constant")
    parts = cells.groupBy("session").agg(F.ceil(F.count_distinct(*keys) / cells_a_task).cast("int").alias("_parts"))
    place = F.pmod(F.xxhash64(*keys), F.col("_parts"))
    dealt = cells.select("session", *keys, "slot", "k").join(parts, "session").withColumn("_part", place.cast("int")).drop("_parts")
    bins = running.select("session", "slot", "bin").join(parts, "session").select(*(F.col(c).alias(c) for c in ("session", "slot", "bin")), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))

    def null(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["session", *keys, "n_spikes", "info", "null_mean", "null_sd", "info_z", "n_null", "n_at_least", "p"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        at = right.sort_values("slot")["bin"].to_numpy(np.int64)
        occupancy = np.bincount(at, minlength=n_bins) * slot_s
        held = occupancy @ smooth
        masks = np.fft.rfft(np.arange(n_bins)[:, None] == at) if len(at) * n_bins <= 1 << 22 else None

        def infos(counts: np.ndarray) -> np.ndarray:
            with np.errstate(all="ignore"):
                return np.round(information(np.where((occupancy >= min_occupancy) & (held > 0), counts @ smooth / held, np.nan), occupancy), digits)

        rows = []
        for key, own in left.groupby(keys, sort=True):
            key = key if isinstance(key, tuple) else (key,)
            slots, k = own["slot"].to_numpy(np.int64), own["k"].to_numpy(float)
            info = float(infos(np.bincount(at[slots], k, n_bins)[None])[0])
            moved = shifts(key, len(at)) if len(at) > 1 else np.empty(0, np.int64)
            other = infos(shifted_counts(slots, k, at, moved, n_bins, masks)) if len(moved) else np.empty(0)
            other = other[np.isfinite(other)]
            mean, sd = (float(other.mean()), float(other.std())) if len(other) else (None, None)
            above = int((other >= info).sum())
            known = np.isfinite(info)
            rows.append((own["session"].iloc[0], *key, int(k.sum()), info if known else None, mean, sd, (info - mean) / sd if known and sd else None, len(other), above, (1 + above) / (1 + len(other)) if known else None))
        return pd.DataFrame(rows, columns=names)

    kinds = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in ("session", *keys))
    by = ["session", "_part"]
    return dealt.groupBy(*by).cogroup(bins.groupBy(*by)).applyInPandas(null, f"{kinds}, n_spikes long, info double, null_mean double, null_sd double, info_z double, n_null long, n_at_least long, p double")


def empirical_p(n_at_least: Column, n: Column | int) -> Column:
    """(1 + #) / (n + 1)."""
    return (n_at_least + 1) / (F.lit(n) + 1 if isinstance(n, int) else n + 1)
