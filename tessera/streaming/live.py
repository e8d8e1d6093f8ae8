"""Operators on unbounded input. Late rows are dropped by watermark; results are those of the batch forms on rows that came in time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .stateful import STORE


def binned_counts(stream: DataFrame, width: str, keys: list[str], *, ts: str = "ts", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """keys, start, end, n: counts in tumbling (or sliding) windows of event time; a window is final once the watermark passes it."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    counts = stream.withWatermark(ts, late).groupBy(w.alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def bursts(stream: DataFrame, gap: str, keys: list[str], *, ts: str = "ts", late: str = "1 hour", least: int = 2) -> DataFrame:
    """keys, start, end, n: runs of rows that follow each other within the gap, with at least so many rows."""
    s = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("_last"))
    return s.where(F.col("n") >= least).select(*keys, F.col("_w.start").alias("start"), F.col("_last").alias("end"), "n")


WHOLE = ("tinyint", "smallint", "int", "bigint")


def _dealt(stream: DataFrame, key: str, groups: int) -> tuple[DataFrame, str]:
    """The rows with _k (the key as state holds it) and _g (its group, -1 without a key), and the type of _k."""
    kind = stream.schema[key].dataType.simpleString()
    held = kind if kind in WHOLE else "string"
    group = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.hash(key), F.lit(groups)))
    return stream.withColumns({"_k": F.col(key).cast(held), "_g": group}), held


def _in_order(rows: pd.DataFrame, key: str, group: int, by: list[str]) -> tuple[pd.DataFrame, list, np.ndarray, np.ndarray]:
    """Rows sorted by key and ``by``, the keys, and where each one's rows start and end."""
    if group == -1:  # NULL, not NaN, which would turn whole keys that leave beside it into doubles
        rows = rows.assign(**{key: None})
    code, keys = (np.zeros(len(rows), int), [None]) if group == -1 else pd.factorize(rows["_k"])
    ranks = [rows[c].to_numpy() if rows[c].dtype.kind in "if" else pd.factorize(rows[c], sort=True)[0] for c in by]
    rows = rows.iloc[np.lexsort((*ranks[::-1], code))]
    sizes = np.bincount(code)
    return rows, keys if group == -1 else keys.tolist(), np.cumsum(sizes) - sizes, np.cumsum(sizes)


def latched(stream: DataFrame, value: str, threshold: float, key: str, *, ts: str = "ts", then: str | None = None, groups: int = 256) -> DataFrame:
    """key, ts, value, latch: the hysteresis latch with one number of state for each key.

    Rows of a key are taken in time order (at one time by ``then``) inside a micro-batch; batches follow each other as they come.
    A row that is older than the last one of an earlier batch, or has no time, can't be put in its place: it takes and gives no
    latch, but passes with the flag ``late``. Keys share their step and their state in ``groups`` hashed groups, as a call for each
    key costs more than its rows; their number belongs to the checkpoint.
    """
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, ts, value)}
    timed = kinds[ts].startswith(("timestamp", "date"))
    clock = "long" if timed or kinds[ts] in WHOLE else "double"
    at = F.unix_micros(F.col(ts).cast("timestamp")) if timed else F.col(ts)
    none = np.iinfo(np.int64).min if clock == "long" else -np.inf

    def step(g: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, latch, last = state.get if state.exists else ([], [], [])
        rows, keys, starts, ends = _in_order(pd.concat(list(batches), ignore_index=True), key, g[0], ["_at", *([then] if then else [])])
        place = {k: n for n, k in enumerate(known)}
        place |= {k: len(place) + n for n, k in enumerate(k for k in keys if k not in place)}
        new = len(place) - len(known)
        latch, last = np.array([*latch, *[0] * new], np.int64), np.array([*last, *[none] * new], np.int64 if clock == "long" else float)
        own, each = np.array([place[k] for k in keys]), np.repeat(np.arange(len(keys)), ends - starts)
        when, v, here = rows["_at"].to_numpy(), rows[value].to_numpy(float, na_value=np.nan), np.arange(len(rows))
        late = (when < last[own][each]) | rows[ts].isna().to_numpy()
        sign = np.where(v > threshold, 1, np.where(v < -threshold, -1, 0))
        turn = np.maximum.accumulate(np.where((sign != 0) & ~late, here, -1))
        out = np.where(turn >= starts[each], sign[turn], latch[own][each])
        newest = np.maximum.accumulate(np.where(late, -1, here))[ends - 1]
        moved = newest >= starts
        latch[own[moved]], last[own[moved]] = out[newest[moved]], when[newest[moved]]
        state.update((list(place), latch.tolist(), last.tolist()))
        yield pd.DataFrame({key: rows[key], ts: rows[ts], value: rows[value], "latch": pd.array(np.where(late, None, out), dtype="Int32"), "late": late})

    rows, held = _dealt(stream.withColumn("_at", F.coalesce(at.cast(clock), F.lit(0).cast(clock))), key, groups)
    rows = rows.select(key, ts, value, "_at", "_k", "_g", *([then] if then and then not in (key, ts, value) else []))
    return rows.groupBy("_g").applyInPandasWithState(step, f"{key} {kinds[key]}, {ts} {kinds[ts]}, {value} {kinds[value]}, latch int, late boolean", f"known array<{held}>, latch array<int>, last array<{clock}>", "append", GroupStateTimeout.NoTimeout)


def halo_filtered(stream: DataFrame, value: str, key: str, i: str, kernel: Callable[[np.ndarray], np.ndarray], halo: int, *, then: str | None = None, groups: int = 256) -> DataFrame:
    """key, i, value, filtered, late: a filter of whole traces over one that goes on, with at most 2 * halo samples of state for each key.

    kernel: samples to as many filtered ones, each of which depends on at most ``halo`` samples on either
    side. A sample leaves once that many have come after it, so the last ``halo`` ones of a key stay in state.
    i is a BIGINT by which a key's samples arrive in order (at one i by ``then``); one that is older than those of an earlier
    micro-batch can't be put back in its place: it leaves at once with NULL and the flag ``late``. NULL samples are NaN to the kernel.
    Keys share their state in ``groups`` hashed groups, as in ``latched``.
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(g: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, sizes, ats, values, sent = state.get if state.exists else ([], [], [], [], [])
        cuts = np.cumsum([0, *sizes]).tolist()
        held = {k: (ats[a:b], values[a:b], n) for k, a, b, n in zip(known, cuts[:-1], cuts[1:], sent, strict=True)}
        rows, keys, starts, ends = _in_order(pd.concat(list(batches), ignore_index=True), key, g[0], [i, *([then] if then else [])])
        when, v = rows[i].to_numpy(), rows[value].to_numpy(float, na_value=np.nan)
        parts = []  # (row of the key, i, value, filtered, late)
        for k, a, b in zip(keys, starts.tolist(), ends.tolist(), strict=True):
            at, x, done = held.get(k, ([], [], 0))
            first = a + int(np.searchsorted(when[a:b], at[-1])) if at else a  # those before are late
            if first > a:
                parts.append((a, when[a:first], v[a:first], np.full(first - a, np.nan), True))
            at, x = np.concatenate([np.array(at, np.int64), when[first:b]]), np.concatenate([np.array(x, float), v[first:b]])
            until = max(done, len(at) - halo)
            if until > done:
                parts.append((a, at[done:until], x[done:until], kernel(x)[done:until], False))
            old = max(0, until - halo)
            held[k] = (at[old:].tolist(), x[old:].tolist(), until - old)
        ats, values, sent = zip(*held.values(), strict=True)
        state.update((list(held), [len(x) for x in ats], list(chain.from_iterable(ats)), list(chain.from_iterable(values)), list(sent)))
        if parts:
            a, at, x, filtered, late = zip(*parts, strict=True)
            n = [len(p) for p in at]
            yield pd.DataFrame({key: rows[key].iloc[np.repeat(a, n)].array, i: np.concatenate(at), value: np.concatenate(x), "filtered": np.concatenate(filtered), "late": np.repeat(late, n)})

    cast = stream.withColumns({i: F.col(i).cast("long"), value: F.col(value).cast("double")}).where(F.col(i).isNotNull())
    rows, kept = _dealt(cast, key, groups)
    rows = rows.select(key, i, value, "_k", "_g", *([then] if then and then not in (key, i, value) else []))
    out = rows.groupBy("_g").applyInPandasWithState(step, f"{key} {kind}, {i} long, {value} double, filtered double, late boolean", f"known array<{kept}>, sizes array<int>, at array<long>, held array<double>, sent array<int>", "append", GroupStateTimeout.NoTimeout)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in (value, "filtered")})


@contextmanager
def set_for_now(spark: SparkSession, *settings: tuple[str, str]) -> Iterator[None]:
    """Settings of the session that hold inside, and no longer."""
    before = {key: spark.conf.get(key, None) for key, _ in settings}
    try:
        for key, value in settings:
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def drained(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> DataFrame:
    """Run a stream over all input there is now and return its result as a table at ``path``.

    append: rows that are final; complete: all rows as of the last micro-batch, each of which writes them anew.
    State is kept in RocksDB, which operators with timers need.
    """
    with set_for_now(stream.sparkSession, STORE):
        return _drained(stream, path, checkpoint, mode)


def _drained(stream: DataFrame, path: str, checkpoint: str, mode: str) -> DataFrame:
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(path)).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def live_upsert(stream: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Write each micro-batch into a versioned keyed table: all rows of the batch for a key replace the key's rows.

    Every batch writes the whole table anew, so batches should be few and large.
    """
    from ..sources.tables import write_upsert

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write_upsert(batch.sparkSession, path, batch, keys)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
