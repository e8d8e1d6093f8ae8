"""Scoring of posteriors as sequences: weighted correlation, shuffles, z scores and cell contributions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .draws import hashed_numbers, placed, stream_numbers

SHUFFLES = ("column_cycle", "time_permutation")


def weighted_correlation(weights: DataFrame, keys: list[str], *, n_bins: int, circular: bool, tbin: str = "tbin", pbin: str = "pbin", weight: str = "p", step: float = 1.0) -> DataFrame:
    """keys, r, offset: weighted Pearson correlation of position and time, on a ring the best |r| over all origins.

    Rows are aggregated to the sums of each (key, offset) in one pass; a side without spread gives r = 0.
    The first offset wins ties.
    """
    fan = weights.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1)))) if circular else weights.withColumn("offset", F.lit(0))
    x = (F.pmod(F.col(pbin) - F.col("offset"), F.lit(n_bins)) if circular else F.col(pbin)).cast("double") * step
    t, w = F.col(tbin).cast("double"), F.col(weight)
    sums = fan.groupBy(*keys, "offset").agg(*(F.sum(e).alias(n) for n, e in (("s", w), ("sx", w * x), ("st", w * t), ("sxx", w * x * x), ("stt", w * t * t), ("sxt", w * x * t))))
    mx, mt = F.try_divide("sx", "s"), F.try_divide("st", "s")
    vx, vt, c = F.try_divide("sxx", "s") - mx * mx, F.try_divide("stt", "s") - mt * mt, F.try_divide("sxt", "s") - mx * mt
    r = F.when((vx > 1e-12) & (vt > 1e-12), c / F.sqrt(vx * vt)).otherwise(0.0)
    each = sums.withColumn("r", F.coalesce(r, F.lit(0.0)))
    # Equal |r| that differ by rounding alone go to the first offset, as exactly equal ones do.
    best = F.max_by(F.struct("r", "offset"), F.struct(F.round(F.abs("r"), 9), -F.col("offset")))
    return each.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.r").alias("r"), F.col("_b.offset").alias("offset"))


def column_cycled(weights: DataFrame, shifts: DataFrame, n_bins: int, pbin: str = "pbin") -> DataFrame:
    """Every time bin's positions rolled by its own shift: shifts has shuffle_id, tbin, shift (shared by directions)."""
    return weights.join(shifts, "tbin").withColumn(pbin, F.pmod(F.col(pbin) + F.col("shift"), F.lit(n_bins))).drop("shift")


def gated(tuning: DataFrame, laps: DataFrame, keys: list[str], least: int, direction: str = "direction", lap: str = "lap") -> DataFrame:
    """tuning of the directions that have ``least`` laps or more (laps: keys, direction, lap): a template of few laps is noise that raises every null."""
    enough = laps.groupBy(*keys, direction).agg(F.countDistinct(lap).alias("_n")).where(F.col("_n") >= least)
    return tuning.join(enough.select(*keys, direction), [*keys, direction], "left_semi")


def best_direction(scores: DataFrame, keys: list[str], r: str = "r") -> DataFrame:
    """keys, abs_r: the largest |r| over directions, taken for the observation and for each shuffle alike."""
    return scores.groupBy(*keys).agg(F.max(F.abs(r)).alias("abs_r"))


def z_score(observed: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd > 0, (observed - mean) / sd)


def null_scores(nulls: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, r, rz, null_mean, null_sd from |r| of each shuffle (nulls: keys, shuffle_id, abs_r) and the observation (keys, r)."""
    stats = nulls.groupBy(*keys).agg(F.avg("abs_r").alias("null_mean"), F.stddev_pop("abs_r").alias("null_sd"), F.count(F.lit(1)).alias("n_shuffles"))
    return observed.join(stats, keys).withColumn("rz", z_score(F.abs("r"), F.col("null_mean"), F.col("null_sd")))


# --- the same for dense posteriors, one event a row ------------------------------------------------


def best_correlation(p: np.ndarray, x: np.ndarray, t: np.ndarray, circular: bool) -> tuple[np.ndarray, np.ndarray]:
    """p: (..., time, position). Correlation and offset with the largest |r| along the last two axes."""
    n = p.shape[-1]
    total = p.sum(axis=(-2, -1))
    pt, px = p.sum(axis=-1), p.sum(axis=-2)
    with np.errstate(all="ignore"):
        mt = pt @ t / total
        vt = pt @ t**2 / total - mt**2
        at = np.einsum("...tp,t->...p", p, t)
        found = []
        for k in range(n if circular else 1):
            pos = np.roll(x, k) if circular else x
            mx = px @ pos / total
            vx = px @ pos**2 / total - mx**2
            r = (at @ pos / total - mx * mt) / np.sqrt(vx * vt)
            found.append(np.where(np.isfinite(r) & (vx > 1e-12) & (vt > 1e-12), r, 0.0))
    r = np.stack(found, axis=-1)
    best = np.abs(r).argmax(axis=-1)
    return np.take_along_axis(r, best[..., None], -1)[..., 0], best


def shuffled(p: np.ndarray, kind: str, n: int, rng: np.random.Generator) -> np.ndarray:
    """(n, directions, time, position): each shuffle is the same for all directions."""
    return shuffled_by(p, kind, rng.integers(1 << 48, size=(n, p.shape[1])))


def shuffled_by(p: np.ndarray, kind: str, numbers: np.ndarray) -> np.ndarray:
    """The same by one number (shuffles, time) for each time bin: what it is rolled by, or its rank in the new order.

    Both kinds pick, for every place of the result, a time bin and a position to copy from.
    """
    times, places = p.shape[1:]
    n = len(numbers)
    time, place = np.broadcast_to(np.arange(times)[:, None], (n, times, 1)), np.broadcast_to(np.arange(places), (n, times, places))
    if kind == "column_cycle":
        place = (place + (numbers % places)[..., None]) % places
    elif kind == "time_permutation":
        time = numbers.argsort(axis=1, kind="stable")[..., None]
    else:
        raise ValueError(f"shuffle is one of {SHUFFLES}")
    return np.moveaxis(p[:, time, place], 0, 1)


def score_events(events: DataFrame, *, circular: bool, kind: str = "column_cycle", n_shuffles: int = 500, least_bins: int = 5, bin_s: float = 0.02, id: str = "event_id", seed: int = 0, one_stream: bool = False) -> DataFrame:
    """``id``, r, rz, direction, offset, null_mean, null_sd, n_bins of events with enough bins.

    events: id, tbins ARRAY<INT> (original numbers of the bins kept), posteriors ARRAY<ARRAY<DOUBLE>> (directions, flattened time x
    position). The observation and each shuffle take the best |r| over directions and offsets alike. A shuffle's numbers are hashes of
    (seed, id, shuffle, bin); with ``one_stream`` those of one sequential generator that draws for event after event in the
    order of their ids, wherever they are worked on.
    """
    size = F.coalesce(F.size("tbins"), F.lit(0))
    kept = events.where(size >= least_bins)
    kept = placed(kept, [id], size * n_shuffles, "_place") if one_stream else kept.withColumn("_place", F.lit(0).cast("long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, tbins, flat, place in zip(pdf[id], pdf["tbins"], pdf["posteriors"], pdf["_place"], strict=True):
                p = np.stack([np.asarray(f, float) for f in flat]).reshape(len(flat), len(tbins), -1)
                x, t = np.arange(p.shape[-1], dtype=float), np.asarray(tbins, float) * bin_s
                r, off = best_correlation(p, x, t, circular)
                d = int(np.abs(r).argmax())
                shape = (n_shuffles, len(tbins))
                numbers = stream_numbers(seed, int(place), shape) if one_stream else hashed_numbers(seed, key, shape)
                null = np.abs(best_correlation(shuffled_by(p, kind, numbers), x, t, circular)[0]).max(axis=1)
                m, s = float(null.mean()), float(null.std())
                rows.append((key, float(r[d]), (abs(float(r[d])) - m) / s if s > 0 else None, d, int(off[d]), m, s, len(tbins)))
            yield pd.DataFrame(rows, columns=[id, "r", "rz", "direction", "offset", "null_mean", "null_sd", "n_bins"])

    kind_ = events.schema[id].dataType.simpleString()
    return kept.select(id, "tbins", "posteriors", "_place").mapInPandas(run, f"{id} {kind_}, r double, rz double, direction int, offset int, null_mean double, null_sd double, n_bins int")


# --- fixed cycles of whole events ------------------------------------------------------------------


def cycled(p: np.ndarray, first: np.ndarray, tbins: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """(1 + shuffles, events): the best |r| over directions and ring offsets of events as they are, and with every time bin rolled by its shift.

    p: (directions, rows, positions), where a row is a time bin of an event and an event's rows follow each other from ``first`` on.
    shifts: (shuffles, time bins). A row's sums of position and its square are made once for each roll; a shuffle picks from them.
    """
    n = p.shape[-1]
    rolled = (np.arange(n)[:, None] + np.arange(n)) % n
    t, total = tbins.astype(float), lambda x: np.add.reduceat(x, first, axis=0)
    begin = np.arange(len(t))[:, None] * n
    picks = [begin + (by[tbins][:, None] - np.arange(n)) % n for by in (np.zeros(shifts.shape[1], int), *shifts)]
    out = np.zeros((len(picks), len(first)))
    for each in p:
        w = each.sum(axis=1)
        s = total(w)[:, None]
        mt = total(w * t)[:, None] / s
        vt = total(w * t * t)[:, None] / s - mt**2
        one, two = (np.ascontiguousarray(each @ x).ravel() for x in (rolled.astype(float), rolled.astype(float) ** 2))
        for best, pick in zip(out, picks, strict=True):
            x = one[pick]
            mx = total(x) / s
            vx = total(two[pick]) / s - mx**2
            with np.errstate(all="ignore"):
                r = (total(x * t[:, None]) / s - mx * mt) / np.sqrt(vx * vt)
            r = np.abs(np.where(np.isfinite(r) & (vx > 1e-12) & (vt > 1e-12), r, 0.0))
            np.maximum(best, r[np.arange(len(r)), np.round(r, 9).argmax(axis=1)], out=best)
    return out


def cycle_null(events: DataFrame, shifts: list[tuple[int, int, int]], tuning: DataFrame | None = None, *, dt: float = 1.0, floor_hz: float = 0.01, variant: str = "variant", events_a_time: int = 1024) -> DataFrame:
    """``events`` with abs_r, null_mean and null_sd: the best |r| over directions and ring offsets, and its null by fixed cycles of the time bins.

    events: tbins ARRAY<INT> (an event without any goes) and either posteriors ARRAY<ARRAY<DOUBLE>> (directions, flattened time x position)
    or, with ``tuning`` (direction, cell, bin, rate), counts ARRAY<ARRAY<DOUBLE>> (time x cells, in the order of the cells' numbers).
    tuning is as large as one template and goes to every task; if it has ``variant``, each event has a row for each of them.
    shifts: (shuffle, tbin, shift) for every time bin there is. An event never leaves its row, so nothing is shuffled for the null.
    """
    moved = np.zeros([1 + max(s[k] for s in shifts) for k in (0, 1)], int)
    for k, t, by in shifts:
        moved[k, t] = by
    moved = moved[sorted({k for k, _, _ in shifts})]
    templates: list[tuple] = [(None, None)]
    kind = {}
    if tuning is not None:
        split = variant in tuning.columns
        kind = {variant: tuning.schema[variant].dataType.simpleString()} if split else {}
        rows = tuning.select(F.col(variant) if split else F.lit(None).alias(variant), "direction", "cell", "bin", "rate").collect()
        axes = [sorted({r[k] for r in rows}) for k in (2, 3)]
        templates = []
        for name in sorted({r[0] for r in rows}) if split else [None] if rows else []:
            ways = sorted({r[1] for r in rows if r[0] == name})
            rates = np.full((len(ways), *map(len, axes)), floor_hz)
            for v, way, c, b, rate in rows:
                if v == name:
                    rates[ways.index(way), axes[0].index(c), axes[1].index(b)] = floor_hz if rate is None or np.isnan(rate) else max(rate, floor_hz)
            templates.append((name, rates))

    def posteriors(batch: pa.RecordBatch, size: np.ndarray, rates: np.ndarray | None) -> np.ndarray:
        if rates is None:
            return np.concatenate([np.stack([np.asarray(d, float).reshape(k, -1) for d in e]) for e, k in zip(batch.column("posteriors").to_pylist(), size, strict=True)], axis=1)
        counts = batch.column("counts").flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(size.sum(), -1)
        x = counts @ np.log(rates) - dt * rates.sum(axis=1)[:, None]
        x = np.exp(x - x.max(axis=-1, keepdims=True))
        return x / x.sum(axis=-1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, events_a_time):
                batch = whole.slice(at, events_a_time)
                tbins = batch.column("tbins")
                size = tbins.value_lengths().to_numpy(zero_copy_only=False).astype(int)
                first = np.concatenate([[0], size.cumsum()[:-1]])
                for name, rates in templates:
                    r = cycled(posteriors(batch, size, rates), first, tbins.flatten().to_numpy(zero_copy_only=False).astype(int), moved)
                    null = r[1:]
                    sd = np.where(null.max(axis=0) > null.min(axis=0), null.std(axis=0), 0.0)  # equal values have no width, whatever their mean is rounded to
                    own = [pa.array([name] * batch.num_rows, variant_kind)] if kind else []
                    yield pa.RecordBatch.from_arrays([*batch.columns, *own, *map(pa.array, (r[0], null.mean(axis=0), sd))], names=[*batch.schema.names, *kind, "abs_r", "null_mean", "null_sd"])

    variant_kind = pa.string() if kind.get(variant, "string") == "string" else pa.int64() if kind[variant] == "bigint" else pa.int32()
    schema = ", ".join(f"`{c}` {t}" for c, t in [*events.dtypes, *kind.items(), *((c, "double") for c in ("abs_r", "null_mean", "null_sd"))])
    return events.where(F.size("tbins") > 0).mapInArrow(run, schema)


# --- contribution of single cells ------------------------------------------------------------------


def placed_posteriors(counts: np.ndarray, rates: np.ndarray, cells: slice, dt: float) -> np.ndarray:
    """(directions, cells, placements, time, position): posteriors with one cell's field moved round by 0 to positions - 1 bins.

    counts: (time, cells). rates: (directions, cells, positions), floored. The sum over cells is made once; a placement
    takes out the cell's own term and puts in the moved one, in all directions alike.
    """
    logs, n = np.log(rates), rates.shape[2]
    whole = np.einsum("tc,dcb->dtb", counts, logs) - dt * rates.sum(axis=1)[:, None]
    moved = (np.arange(n) - np.arange(n)[:, None]) % n
    gained = logs[:, cells][..., moved] - logs[:, cells][:, :, None]
    cost = rates[:, cells][..., moved] - rates[:, cells][:, :, None]
    x = whole[:, None, None] + np.einsum("tc,dcsb->dcstb", counts[:, cells], gained) - dt * cost[:, :, :, None]
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def placed_scores(counts: np.ndarray, tbins: np.ndarray, rates: np.ndarray, dt: float, circular: bool, null: tuple | None, n_shuffles: int = 0, kind: str = "column_cycle", seed: tuple = (), most: int = 1 << 20) -> np.ndarray:
    """(cells, placements): z scores of the best |r| over directions and offsets. NaN where the null has no width.

    null: (mean, sd) of the event's own shuffles, taken for every placement; None: ``n_shuffles`` fresh ones of each placement.
    Cells are worked on in blocks of about ``most`` numbers.
    """
    directions, n_cells, n = rates.shape
    x, t = np.arange(n, dtype=float), np.asarray(tbins, float)
    step = max(1, most // (directions * n * len(t) * n))
    out = np.full((n_cells, n), np.nan)
    for at in range(0, n_cells, step):
        p = placed_posteriors(counts, rates, slice(at, at + step), dt)
        best = np.abs(best_correlation(p, x, t, circular)[0]).max(axis=0)
        if null is not None:
            m, s = (np.full(best.shape, np.nan if v is None else float(v)) for v in null)
        else:
            m, s = np.empty(best.shape), np.empty(best.shape)
            for c, k in np.ndindex(best.shape):
                each = shuffled(p[:, c, k], kind, n_shuffles, np.random.default_rng([*seed, at + c, k]))
                each = np.abs(best_correlation(each, x, t, circular)[0]).max(axis=1)
                m[c, k], s[c, k] = each.mean(), each.std()
        with np.errstate(all="ignore"):
            out[at : at + step] = np.where(s > 0, (best - m) / s, np.nan)
    return out


def placement_means(events: DataFrame, tuning: DataFrame, keys: list[str], *, dt: float, circular: bool, fresh: bool = False, n_shuffles: int = 500, kind: str = "column_cycle", id: str = "event_id", floor_hz: float = 0.01, least_bins: int = 5, seed: int = 0) -> DataFrame:
    """keys, cell, shift, mean_rz, n_events, mean_rz_present, n_present: every event scored again with each cell's field at each place.

    events: keys, id, tbins ARRAY<INT> (bins with spikes), counts ARRAY<ARRAY<DOUBLE>> (time x cells, in the order of the cells'
    numbers in ``tuning``) and, unless ``fresh``, null_mean and null_sd. tuning: direction, cell, bin, rate; as large as one
    template, it goes to every task. Shift 0 is the field as it is. An event counts for a cell only if every placement has a
    score; "present" ones have a spike of the cell. Tasks return sums by (keys, cell, shift), one row each for their events, never a row
    for each event.
    """
    rows = tuning.select("direction", "cell", "bin", "rate").collect()
    axes = [sorted({r[k] for r in rows}) for k in range(3)]
    at = [{v: i for i, v in enumerate(axis)} for axis in axes]
    rates = np.full([len(axis) for axis in axes], floor_hz)
    for d, c, b, rate in rows:
        rates[at[0][d], at[1][c], at[2][b]] = floor_hz if rate is None or np.isnan(rate) else max(rate, floor_hz)
    cells = axes[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for i, row in enumerate(pdf[keys].itertuples(index=False, name=None)):
                tbins, counts = pdf["tbins"].iloc[i], pdf["counts"].iloc[i]
                if tbins is None or len(tbins) < least_bins:
                    continue
                n = np.stack([np.asarray(c, float) for c in counts])
                null = None if fresh else (pdf["null_mean"].iloc[i], pdf["null_sd"].iloc[i])
                scores = placed_scores(n, tbins, rates, dt, circular, null, n_shuffles, kind, (seed, int(pdf[id].iloc[i])))
                for c, z in enumerate(scores):
                    if np.isfinite(z).all():
                        here = float(n[:, c].any())
                        held = sums.setdefault((*row, c), np.zeros((len(z), 4)))
                        held += np.stack([z, np.ones(len(z)), z * here, np.full(len(z), here)], axis=1)
        out = [(*key[:-1], cells[key[-1]], shift, *values) for key, held in sums.items() for shift, values in enumerate(held)]
        yield pd.DataFrame(out, columns=[*keys, "cell", "shift", "s", "n", "sp", "np"])

    kinds = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    columns = [*keys, id, "tbins", "counts", *([] if fresh else ["null_mean", "null_sd"])]
    parts = events.select(*dict.fromkeys(columns)).mapInPandas(run, f"{kinds}, cell {tuning.schema['cell'].dataType.simpleString()}, shift int, s double, n double, sp double, np double")
    total = parts.groupBy(*keys, "cell", "shift").agg(*(F.sum(c).alias(c) for c in ("s", "n", "sp", "np")))
    return total.select(*keys, "cell", "shift", (F.col("s") / F.col("n")).alias("mean_rz"), F.col("n").cast("long").alias("n_events"), F.try_divide("sp", "np").alias("mean_rz_present"), F.col("np").cast("long").alias("n_present"))


def placement_contribution(means: DataFrame, keys: list[str], value: str = "mean_rz") -> DataFrame:
    """keys, pcc, z, p, n_shifts from (keys, shift, value): how far the field's own place (shift 0) stands above the mean of all others.

    z by the others' sample deviation; p: the share of places that lie as far from that mean, on either side,
    the own one counted with them. NULL without a score of the own place or with under two others.
    """
    own, others = F.max(F.when(F.col("shift") == 0, F.col(value))), F.col("shift") > 0
    w = Window.partitionBy(*keys)
    shown = means.where(F.col(value).isNotNull()).withColumn("_own", own.over(w)).where(others).withColumn("_mean", F.avg(value).over(w))
    far = F.count_if(F.abs(F.col(value) - F.col("_mean")) >= F.abs(F.col("_own") - F.col("_mean")))
    out = shown.groupBy(*keys, "_own", "_mean").agg(F.stddev_samp(value).alias("_sd"), far.alias("_far"), F.count(F.lit(1)).alias("n_shifts"))
    fine = F.col("_own").isNotNull() & (F.col("n_shifts") >= 2)
    pcc = F.col("_own") - F.col("_mean")
    return out.select(*keys, F.when(fine, pcc).alias("pcc"), F.when(fine, z_score(F.col("_own"), F.col("_mean"), F.col("_sd"))).alias("z"), F.when(fine, (1 + F.col("_far")) / (F.col("n_shifts") + 1)).alias("p"), "n_shifts")


def finite_everywhere(scores: DataFrame, event: list[str], placement: str, value: str, n_placements: int) -> DataFrame:
    """Scores of events that are defined at every placement."""
    fine = scores.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*event).agg(F.countDistinct(placement).alias("_n")).where(F.col("_n") == n_placements)
    return scores.join(fine.select(*event), event, "left_semi")


def contribution(shifts: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pcc (observed mean - mean over shifts), z (sample deviation), p: shifts has keys, shift, mean_rz; observed keys, mean_rz."""
    stats = shifts.select(*keys, F.col("mean_rz").alias("_s")).join(observed.select(*keys, F.col("mean_rz").alias("_o")), keys)
    out = stats.groupBy(*keys, "_o").agg(F.avg("_s").alias("_m"), F.stddev_samp("_s").alias("_sd"), F.count_if(F.col("_s") >= F.col("_o")).alias("_k"), F.count(F.lit(1)).alias("_n"))
    return out.select(*keys, (F.col("_o") - F.col("_m")).alias("pcc"), z_score(F.col("_o"), F.col("_m"), F.col("_sd")).alias("z"), ((1 + F.col("_k")) / (1 + F.col("_n"))).alias("p"))


def null_contributions(shifts: DataFrame, keys: list[str], value: str = "mean_rz") -> DataFrame:
    """Each shift against the mean of all other shifts of its key; NULL for a single shift."""
    w = Window.partitionBy(*keys)
    n, s = F.count(F.lit(1)).over(w), F.sum(value).over(w)
    return shifts.withColumn("null_pcc", F.col(value) - F.try_divide(s - F.col(value), n - 1))
