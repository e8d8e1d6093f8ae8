"""Band envelopes of long recordings, channel profiles, and support of events over channels.

Filters run over chunks exactly (``filters.zero_phase``). The analytic signal of a chunk is made with a halo of
neighbours, which is cut off again; a trace of one chunk is transformed whole. Frames are rows (i, values ARRAY<SMALLINT>), and only the channels asked for leave
the scan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import smooth_numpy
from ..functions.signal import analytic_amplitude, band_envelope, band_sections, bandpass, top_peaks
from ..sources.tables import written
from .chunks import with_halo
from .filters import zero_phase
from .percentiles import exact_percentiles

CHUNK, HALO = 1 << 21, 1 << 11
FILTER_CHUNK = 1 << 18


def channel_envelope(frames: DataFrame, channels: list[int], *, rate_hz: float, band: tuple[float, float], sigma_ms: float = 0.0, order: int = 3, chunk: int = CHUNK, halo: int = HALO, keys: list[str] | None = None) -> DataFrame:
    """keys, channel, i, v FLOAT: smoothed band envelope of each channel; chunks don't show in the result beyond the analytic signal's far reach."""
    keys = keys or ["session"]
    sigma = sigma_ms * rate_hz / 1000
    halo = halo + int(4 * sigma + 0.5)
    long = frames.select(*keys, "i", F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.element_at("values", c + 1).cast("double").alias("x")) for c in channels))).alias("_c")).select(*keys, "i", "_c.*")
    passed = zero_phase(long, [*keys, "channel"], band_sections(rate_hz, band, order), chunk=min(chunk, FILTER_CHUNK))
    cut = with_halo(passed, "i", chunk, halo)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["_core"].any():  # only the halo of a chunk beyond the trace
            return pd.DataFrame(columns=[*keys, "channel", "i", "v"])
        pdf = pdf.sort_values("i")
        env = analytic_amplitude(pdf["x"].to_numpy()).astype(np.float32)
        if sigma:
            env = smooth_numpy(env, sigma).astype(np.float32)
        return pdf.assign(v=env)[pdf["_core"].to_numpy()][[*keys, "channel", "i", "v"]]

    kinds = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)
    return cut.groupBy(*keys, "channel", "_chunk").applyInPandas(run, f"{kinds}, channel int, i long, v float")


def channel_profile(frames: DataFrame, channels: list[int], bands: dict[str, tuple[float, float]], *, rate_hz: float, keys: list[str] | None = None, order: int = 3, **pieces) -> DataFrame:
    """keys, channel, band, mean, median, p99 of the envelope, and the raw standard deviation, of the given frames.

    Envelopes are made in pieces (``chunk`` and ``halo`` of channel_envelope) and written once; percentiles are exact, and
    no task holds a channel for them either.
    """
    keys = keys or ["session"]
    value = F.element_at("values", F.col("channel") + 1).cast("double")
    raw = frames.select(*keys, "values", F.explode(F.array(*map(F.lit, channels))).alias("channel")).groupBy(*keys, "channel").agg(F.stddev_pop(value).alias("sd"))
    out = None
    for name, band in bands.items():
        envelope = written(channel_envelope(frames, channels, rate_hz=rate_hz, band=band, keys=keys, order=order, **pieces), "envelope")
        at = exact_percentiles(envelope, [*keys, "channel"], "v", [0.5, 0.99])
        mean = envelope.groupBy(*keys, "channel").agg(F.avg("v").alias("mean"))
        part = mean.join(at, [*keys, "channel"]).select(*keys, "channel", F.lit(name).alias("band"), "mean", F.col("percentiles")[0].alias("median"), F.col("percentiles")[1].alias("p99"))
        out = part if out is None else out.unionByName(part)
    return out.join(raw, [*keys, "channel"])


def select_per_group(profile: DataFrame, channels: DataFrame, keys: list[str], value: str, group: str = "shank") -> DataFrame:
    """keys, group, channel, value, runner_up, margin: the best channel of each group by value (first in group order on ties).

    channels: keys, group, channel, pos (order in the group), skip. margin is how much of the winner's value the runner-up lacks.
    """
    w = Window.partitionBy(*keys, group).orderBy(F.desc(value), "pos")
    rows = profile.join(channels.where(~F.coalesce("skip", F.lit(False))), [*keys, "channel"])
    ranked = rows.withColumn("_r", F.row_number().over(w)).withColumn("runner_up", F.lead(value).over(w)).where("_r = 1")
    return ranked.select(*keys, group, "channel", F.col(value), "runner_up", F.try_divide(F.col(value) - F.col("runner_up"), F.col(value)).alias("margin"))


def best_channel(choices: DataFrame, value: str, group: str = "shank") -> DataFrame:
    return choices.orderBy(F.desc(value), group).limit(1)


def disagreements(first: DataFrame, second: DataFrame, keys: list[str], group: str = "shank") -> DataFrame:
    """Groups where two selections chose different channels."""
    both = first.select(*keys, group, F.col("channel").alias("first_channel")).join(second.select(*keys, group, F.col("channel").alias("second_channel")), [*keys, group])
    return both.where("first_channel <> second_channel")


def ripple_z(profile: DataFrame, keys: list[str], value: str = "mean") -> DataFrame:
    """``profile`` with z of the value over channels, by population deviation; NULL without spread."""
    w = Window.partitionBy(*keys, "band")
    sd = F.stddev_pop(value).over(w)
    return profile.withColumn("z", F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd))


def windowed_peak_z(frames: DataFrame, events: DataFrame, baselines: DataFrame, *, rate_hz: float, band: tuple[float, float], window_s: float = 0.02, pad_s: float = 0.2, sigma_ms: float = 0.0, order: int = 3) -> DataFrame:
    """session, event_id, channel, z: the largest envelope within the window of each event's peak, in baseline units.

    Each event reads its own padded stretch once for all channels; the padding is filtered and thrown away. baselines:
    session, channel, mean, sd.
    """
    from .intervals import points_in_intervals

    reach = window_s + pad_s
    spans = events.select("session", "event_id", F.col("peak"), (F.col("peak") - reach).alias("start"), (F.col("peak") + reach).alias("end"))
    rows = points_in_intervals(frames.withColumn("t", F.col("i") / rate_hz), spans, ["session"], closed="both", width=10.0)
    packed = baselines.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("channel", F.struct("mean", "sd")))).alias("_b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        base = dict(pdf["_b"].iloc[0])
        x = np.stack([np.asarray(v, float) for v in pdf["values"]])[:, sorted(base)]
        e = band_envelope(x, rate_hz, band, order)
        if sigma_ms:
            e = smooth_numpy(e, sigma_ms * rate_hz / 1000, axis=0)
        near = np.abs(pdf["t"].to_numpy() - pdf["peak"].iloc[0]) <= window_s
        top = e[near].max(axis=0) if near.any() else np.full(len(base), np.nan)
        rows = []
        for k, c in enumerate(sorted(base)):
            m, s = (base[c][f] for f in ("mean", "sd"))
            rows.append((pdf["session"].iloc[0], pdf["event_id"].iloc[0], int(c), float((top[k] - m) / s) if s and s > 0 and np.isfinite(top[k]) else None))
        return pd.DataFrame(rows, columns=["session", "event_id", "channel", "z"])

    joined = rows.join(packed, "session")  # a row for each recording, of as many entries as it has channels
    return joined.groupBy("session", "event_id").applyInPandas(run, f"session string, event_id {events.schema['event_id'].dataType.simpleString()}, channel int, z double")


def shank_support(z: DataFrame, keys: list[str], threshold: float = 2.0) -> DataFrame:
    """keys, n_supporting, n_channels, fraction: channels whose z reaches the threshold; undefined z support nothing."""
    yes = F.count_if(F.col("z").isNotNull() & ~F.isnan("z") & (F.col("z") >= threshold))
    return z.groupBy(*keys).agg(yes.alias("n_supporting"), F.countDistinct("channel").alias("n_channels")).withColumn("fraction", F.try_divide("n_supporting", "n_channels"))


def support_distribution(support: DataFrame, keys: list[str], n_channels: int) -> DataFrame:
    """keys, n_supporting 0..n_channels, n_events with zeros."""
    spine = support.select(*keys).distinct().withColumn("n_supporting", F.explode(F.sequence(F.lit(0), F.lit(n_channels))).cast("long"))
    n = support.groupBy(*keys, "n_supporting").agg(F.count(F.lit(1)).alias("n_events"))
    return spine.join(n, [*keys, "n_supporting"], "left").fillna(0, ["n_events"])


def raw_and_filtered(x: np.ndarray, rate_hz: float, band: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    return x, bandpass(x, rate_hz, band)


def largest_peaks(envelope: DataFrame, keys: list[str], *, rate_hz: float, n: int, refractory_s: float) -> DataFrame:
    """keys, rank, i, v: the largest envelope samples at least a refractory time apart.

    A winner shuts out fewer than two refractory times of samples, so all winners are among the
    n * (2 * refractory + 1) largest samples; only these go to the sequential step.
    """
    most = n * (2 * int(np.ceil(refractory_s * rate_hz)) + 1)
    w = Window.partitionBy(*keys).orderBy(F.desc("v"), "i")
    best = envelope.select(*keys, "i", F.col("v").cast("double").alias("v")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["v", "i"], ascending=[False, True])
        out: list[tuple] = []
        for i, v in zip(pdf["i"], pdf["v"], strict=True):
            if all(abs(i - j) >= refractory_s * rate_hz for _, j, _ in out):
                out.append((len(out) + 1, i, v))
                if len(out) == n:
                    break
        return pd.DataFrame([(*pdf[keys].iloc[0], *o) for o in out], columns=[*keys, "rank", "i", "v"])

    kinds = ", ".join(f"{k} {envelope.schema[k].dataType.simpleString()}" for k in keys)
    return best.groupBy(*keys).applyInPandas(run, f"{kinds}, rank int, i long, v double")


__all__ = ["best_channel", "channel_envelope", "channel_profile", "disagreements", "largest_peaks", "raw_and_filtered", "ripple_z", "select_per_group", "shank_support", "support_distribution", "top_peaks", "windowed_peak_z", "with_halo"]
