"""Detectors and filters on streams with event-time timers: samples are taken in order once the watermark has passed them,
and a key that has been silent for ``idle`` gives what it still holds and leaves no state.

Both need the RocksDB state store, for which ``live.drained`` (or the caller) sets ``STORE``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Holds samples back until the watermark has passed them, then hands them on in order; one timer a key."""

    pending = "ts long, i long, t double, v double, low boolean, high boolean"
    state = ""

    def __init__(self, key: str, idle_ms: int):
        self.key, self.idle_ms = key, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.pending)
        self.held = handle.getValueState("held", self.state)
        self.last = handle.getValueState("last", "ts long, i long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))
        new = new.drop(columns=[self.key]).sort_values(["ts", "i"], kind="stable")
        last = self.last.get() if self.last.exists() else None
        if last is not None:  # what comes after its place has been worked on can't be put back
            new = new[(new["ts"] > last[0]) | ((new["ts"] == last[0]) & (new["i"] > last[1]))]
        waiting = [*(self.waiting.get() if self.waiting.exists() else ()), *new.itertuples(index=False, name=None)]
        yield from self._advance(key, sorted(map(tuple, waiting), key=lambda r: r[:2]), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting = sorted(map(tuple, self.waiting.get() if self.waiting.exists() else ()), key=lambda r: r[:2])
        yield from self._advance(key, waiting, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, waiting: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        ready = [r for r in waiting if r[0] < watermark]
        waiting = waiting[len(ready) :]
        held = self.held.get() if self.held.exists() else None
        out = []
        last = self.last.get() if self.last.exists() else None
        for at, r in enumerate(ready):  # a silence inside what has come is one as well
            before = ready[at - 1][0] if at else last[0] if last is not None else r[0]
            if r[0] - before > self.idle_ms:
                found, held = self.take(held, ready[:at]) if at else ([], held)
                out += [*found, *self.flush(held)]
                ready_rest = ready[at:]
                self.last.update(ready[at - 1][:2]) if at else None
                more, held = self._rest(ready_rest)
                out += more
                break
        else:
            found, held = self.take(held, ready)
            out += found
        if ready:
            last = ready[-1][:2]
            self.last.update(last)
        silent = last is not None and not waiting and watermark > last[0] + self.idle_ms
        if silent:
            out += self.flush(held)
            for state in (self.held, self.waiting, self.last):
                state.clear()
        else:
            self.held.update(held) if held is not None else self.held.clear()
            self.waiting.put(waiting) if waiting else self.waiting.clear()
        for timer in [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        if not silent and (waiting or last is not None):
            self.handle.registerTimer(max(watermark, waiting[-1][0] if waiting else last[0] + self.idle_ms) + 1)
        if out:
            yield self.rows(key[0], out)

    def _rest(self, ready: list[tuple]) -> tuple[list, tuple | None]:
        """Samples after a silence, from an empty state; silences among them too."""
        out, held, first = [], None, 0
        for at in range(1, len(ready)):
            if ready[at][0] - ready[at - 1][0] > self.idle_ms:
                found, held = self.take(held, ready[first:at])
                out, held, first = [*out, *found, *self.flush(held)], None, at
        found, held = self.take(held, ready[first:])
        return [*out, *found], held

    def take(self, held: tuple | None, ready: list[tuple]) -> tuple[list, tuple | None]:
        raise NotImplementedError

    def flush(self, held: tuple | None) -> list:
        raise NotImplementedError

    def rows(self, key, out: list) -> pd.DataFrame:
        raise NotImplementedError


class TwoThresholds(InOrder):
    """State: the last sample's number, the open run (start, last, reached, peak, its time) and the candidate (start, last, peak, its time)."""

    state = "i long, open boolean, r0 double, r1 double, reached boolean, rv double, rt double, has boolean, c0 double, c1 double, cv double, ct double"

    def __init__(self, key: str, idle_ms: int, merge_gap: float, least: float, most: float, dt: float):
        super().__init__(key, idle_ms)
        self.gap, self.least, self.most, self.dt = merge_gap, least, most, dt

    def _event(self, c: tuple) -> list:
        duration = c[1] + self.dt - c[0]
        return [(c[0], c[3], c[1] + self.dt, c[2])] if self.least - 1e-9 <= duration <= self.most + 1e-9 else []

    def _ended(self, run: tuple, candidate: tuple | None) -> tuple[list, tuple | None]:
        """A run is over: (events that are final, the candidate from now on)."""
        start, last, reached, v, t = run
        if not reached:
            return [], candidate
        if candidate is None:
            return [], (start, last, v, t)
        if start - candidate[1] < self.gap:
            return [], (candidate[0], last, *((v, t) if v > candidate[2] else candidate[2:]))
        return self._event(candidate), (start, last, v, t)

    def _opened(self, held: tuple | None) -> tuple[int | None, tuple | None, tuple | None]:
        if held is None:
            return None, None, None
        return held[0], tuple(held[2:7]) if held[1] else None, tuple(held[8:12]) if held[7] else None

    def take(self, held, ready):
        before, run, candidate = self._opened(held)
        out = []
        for _, i, t, v, low, high in ready:
            if run and (not low or i != before + 1):
                found, candidate = self._ended(run, candidate)
                out, run = out + found, None
            if low:
                run = (run[0], t, run[2] or high, *((v, t) if v > run[3] else run[3:])) if run else (t, t, high, v, t)
            if candidate and t - candidate[1] >= self.gap and (run is None or run[0] - candidate[1] >= self.gap):
                out, candidate = out + self._event(candidate), None
            before = i
        if before is None:
            return out, None
        return out, (before, run is not None, *(run or (0.0, 0.0, False, 0.0, 0.0)), candidate is not None, *(candidate or (0.0, 0.0, 0.0, 0.0)))

    def flush(self, held):
        _, run, candidate = self._opened(held)
        out = []
        if run:
            out, candidate = self._ended(run, candidate)
        return [*out, *(self._event(candidate) if candidate else [])]

    def rows(self, key, out):
        return pd.DataFrame([(key, *r) for r in out], columns=[self.key, "start", "peak", "end", "peak_value"])


class HaloFilter(InOrder):
    """State: the samples that a filter still needs or that wait for those after them."""

    state = "ts array<long>, i array<long>, v array<double>, sent int"

    def __init__(self, key: str, idle_ms: int, kernel: Callable[[np.ndarray], np.ndarray], halo: int):
        super().__init__(key, idle_ms)
        self.kernel, self.halo = kernel, halo

    def _filtered(self, ts, i, v, since: int, until: int) -> list:
        if until <= since:
            return []
        made = self.kernel(np.array([np.nan if x is None else x for x in v], float))
        return [(ts[k], i[k], v[k], float(made[k])) for k in range(since, until)]

    def take(self, held, ready):
        ts, i, v, sent = (list(held[0]), list(held[1]), list(held[2]), held[3]) if held is not None else ([], [], [], 0)
        ts, i, v = ts + [r[0] for r in ready], i + [r[1] for r in ready], v + [r[3] for r in ready]
        until = max(sent, len(i) - self.halo)
        out = self._filtered(ts, i, v, sent, until)
        old = max(0, until - self.halo)
        return out, (ts[old:], i[old:], v[old:], until - old) if i else None

    def flush(self, held):
        return self._filtered(*held[:3], held[3], len(held[1])) if held is not None else []

    def rows(self, key, out):
        return pd.DataFrame([(key, *r[1:]) for r in out], columns=[self.key, "i", "v", "filtered"])


def _ordered(stream: DataFrame, key: str, ts: str, late: str, columns: list[Column], processor: InOrder, out: str) -> DataFrame:
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(F.col(key), ts, *columns)
    # The state's columns, in its order; the event time itself stays for the watermark alone.
    rows = rows.select(key, F.unix_millis(ts).alias("ts"), *(c for c in rows.columns if c not in (key, ts)))
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, {out}", "Append", "EventTime")


def two_threshold_events(stream: DataFrame, key: str, *, low: Column, high: Column, merge_gap: float, min_duration: float, max_duration: float, dt: float, idle: float, late: str = "0 seconds", value: str = "v", i: str = "i", t: str = "t", ts: str = "ts") -> DataFrame:
    """key, start, peak, end, peak_value: the events of ``operators.detect.two_threshold``, each as soon as nothing to come can change it.

    i numbers a key's samples, t is their time in seconds, ts the event time that the watermark goes by. Samples may come in any
    order within ``late``; what comes later still is dropped. A key without samples for ``idle`` seconds (at least ``merge_gap``)
    ends its open run and candidate, and its state goes. A NULL value is under every threshold.
    """
    if idle < merge_gap:
        raise ValueError("idle is at least the gap within which events merge")
    columns = [F.col(i).cast("long").alias("i"), F.col(t).cast("double").alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(float("-inf"))).alias("v"), F.coalesce(F.col(value) >= low, F.lit(False)).alias("low"), F.coalesce(F.col(value) >= high, F.lit(False)).alias("high")]
    return _ordered(stream, key, ts, late, columns, TwoThresholds(key, round(idle * 1000), merge_gap, min_duration, max_duration, dt), "start double, peak double, end double, peak_value double")


def filtered(stream: DataFrame, key: str, kernel: Callable[[np.ndarray], np.ndarray], halo: int, *, idle: float, late: str = "0 seconds", value: str = "v", i: str = "i", ts: str = "ts") -> DataFrame:
    """key, i, v, filtered: a filter of whole traces over one that goes on; every sample leaves, the last ``halo`` ones once the key is idle.

    kernel: samples to as many filtered ones, each of which depends on at most ``halo`` samples on either side. Samples may come in any
    order within ``late``. A silence of more than ``idle`` seconds ends a trace: what comes after it is another one. NULL samples are NaN
    to the kernel; NaN results are NULL.
    """
    columns = [F.col(i).cast("long").alias("i"), F.lit(0.0).alias("t"), F.col(value).cast("double").alias("v"), F.lit(False).alias("low"), F.lit(False).alias("high")]
    out = _ordered(stream, key, ts, late, columns, HaloFilter(key, round(idle * 1000), kernel, halo), "i long, v double, filtered double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("v", "filtered")})
