"""A generated recording: sleep, a run on a linear track, sleep; seeded."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..schema import EPOCHS, POSITION, SESSIONS, SPIKES, STATES, UNITS

NAME = "Cedric_01022030"
PYR, INT = (102, 103, 205), (104, 210)


def recording(spark: SparkSession, seed: int = 0, n_spikes: int = 2000, laps: float = 6.0) -> dict[str, DataFrame]:
    """sessions, spikes, units, position, epochs, states of one session of 300 s.

    The position is a sine over a 1.6 m track, with stretches where it is undefined.
    """
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0.01, 299.9, n_spikes))
    ids = rng.choice([*PYR, *INT], n_spikes)
    ids[:5] = [*PYR, *INT]
    dt = 0.0256
    at = np.arange(100.0, 160.0, dt)
    x = 0.8 + 0.8 * np.sin(2 * math.pi * (at - 100) / 60 * laps)
    position = [(NAME, k, float(a), None if 50 <= k < 60 else float(v), None if 50 <= k < 60 else 0.3, None if 40 <= k < 70 else float(v)) for k, (a, v) in enumerate(zip(at, x, strict=True))]
    states = {"Wake": [(0, 20), (100, 160)], "Drowsy": [(20, 30)], "NREM": [(30, 80), (170, 250)], "Intermediate": [(80, 82)], "REM": [(82, 95), (250, 290)]}
    make = spark.createDataFrame
    return {
        "sessions": make([(NAME, NAME.split("_")[0], "1.6m Linear Maze", "linear", 1.6, 300.0)], SESSIONS),
        "spikes": make([(NAME, int(i), float(s)) for i, s in zip(ids, t, strict=True)], SPIKES),
        "units": make([(NAME, i, "pyr" if i in PYR else "int", i // 100) for i in (*PYR, *INT)], UNITS),
        "position": make(position, POSITION),
        "epochs": make([(NAME, "PRE", 0.0, 100.0), (NAME, "MAZE", 100.0, 160.0), (NAME, "POST", 160.0, 300.0)], EPOCHS),
        "states": make([(NAME, s, float(a), float(b)) for s, spans in states.items() for a, b in spans], STATES),
    }


def place_cell_spikes(position: list[tuple[float, float]], centre: float, rng: np.random.Generator, *, peak_hz: float = 10.0, base_hz: float = 0.1, width: float = 0.2) -> list[float]:
    """Spike times of a cell whose rate is a bump over the position; position: (t, x)."""
    dt = position[1][0] - position[0][0]
    out: list[float] = []
    for t, x in position:
        n = rng.poisson((base_hz + peak_hz * math.exp(-0.5 * ((x - centre) / width) ** 2)) * dt)
        out += (t + rng.random(n) * dt).tolist()
    return sorted(out)


def pink_with_bursts(n: int, channels: int, rate_hz: float, at_s: list[float], channel: int, *, seed: int = 0, amplitude: float = 120.0, hz: float = 190.0, length_s: float = 0.06, noise: float = 12.0) -> np.ndarray:
    """int16 samples (n, channels) of 1/f noise with bursts planted in one channel."""
    rng = np.random.default_rng(seed)
    spectrum = np.fft.rfft(rng.normal(size=(n, channels)), axis=0)
    f = np.fft.rfftfreq(n, 1 / rate_hz)
    x = np.fft.irfft(spectrum / np.sqrt(np.maximum(f, f[1]))[:, None], n, axis=0)
    x = x / x.std(axis=0) * noise
    t = np.arange(n) / rate_hz
    for s in at_s:
        x[:, channel] += amplitude * np.exp(-0.5 * ((t - s) / (length_s / 4)) ** 2) * np.sin(2 * np.pi * hz * (t - s))
    return x.round().astype(np.int16)
