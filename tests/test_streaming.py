from __future__ import annotations

from pyspark.sql import functions as F
from tessera.functions.kernels import smooth_numpy
from tessera.sources import tables
from tessera.streaming import live


def drained(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
        return df.sparkSession.table(name).collect()
    finally:
        q.stop()


def source(spark, tmp_path, rows):
    """Rows in time order, one file each part, and a last row far ahead that closes every window."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "k int, s long, v double").select("k", F.timestamp_seconds("s").alias("ts"), "v").coalesce(1).write.parquet(f"{tmp_path}/in/p={k}")
    schema = "k int, ts timestamp, v double"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


PARTS = [[(1, 0, 1.0), (1, 30, 30.0), (2, 40, -40.0)], [(1, 70, 2.0), (1, 400, -50.0), (2, 410, 3.0)], [(9, 100_000, 0.0)], [(9, 200_000, 0.0)]]


def test_tumbling_counts(spark, tmp_path):
    rows = drained(live.binned_counts(source(spark, tmp_path, PARTS), "60 seconds", ["k"], late="0 seconds"), "tumbling")
    assert {(r["k"], int(r["start"].timestamp()), r["n"]) for r in rows if r["k"] != 9} == {(1, 0, 2), (1, 60, 1), (1, 360, 1), (2, 0, 1), (2, 360, 1)}


def test_bursts(spark, tmp_path):
    rows = drained(live.bursts(source(spark, tmp_path, PARTS), "60 seconds", ["k"], late="0 seconds"), "bursts")
    assert {(r["k"], int(r["start"].timestamp()), int(r["end"].timestamp()), r["n"]) for r in rows if r["k"] != 9} == {(1, 0, 70, 3)}


def test_latch_keeps_its_state_over_batches(spark, tmp_path):
    rows = drained(live.latched(source(spark, tmp_path, PARTS), "v", 25.0, "k"), "latch")
    got = {(r["k"], int(r["ts"].timestamp())): r["latch"] for r in rows}
    assert {k: v for k, v in got.items() if k[0] != 9} == {(1, 0): 0, (1, 30): 1, (1, 70): 1, (1, 400): -1, (2, 40): -1, (2, 410): -1}


def test_upsert_by_micro_batch(spark, tmp_path):
    stream = source(spark, tmp_path, [[(1, 0, 1.0), (2, 0, 2.0)], [(2, 9, 5.0)]])
    live.live_upsert(stream, f"{tmp_path}/out", ["k"], f"{tmp_path}/ck").awaitTermination()
    assert {(r["k"], r["v"]) for r in tables.read_versioned(spark, f"{tmp_path}/out").collect()} == {(1, 1.0), (2, 5.0)}


def test_late_rows_of_the_latch_are_flagged(spark, tmp_path):
    stream = source(spark, tmp_path, [[(1, 100, 30.0)], [(1, 50, -40.0), (1, 110, 1.0)]])
    got = {int(r["ts"].timestamp()): (r["latch"], r["late"]) for r in drained(live.latched(stream, "v", 25.0, "k"), "late_latch")}
    assert got == {100: (1, False), 50: (None, True), 110: (1, False)}


def test_a_filter_goes_on_over_batches(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    values = {1: rng.normal(size=60).tolist(), 2: rng.normal(size=3).tolist()}  # the second is shorter than the halo
    parts = [[(k, s, v[s]) for k, v in values.items() for s in range(lo, min(hi, len(v)))] for lo, hi in ((0, 2), (2, 25), (25, 26), (26, 60))]
    stream = source(spark, tmp_path, [*parts, [(1, 5, 9.0)]]).select("k", F.unix_seconds("ts").alias("s"), "v")
    got = drained(live.halo_filtered(stream, "v", "k", "s", lambda x: smooth_numpy(x, 1.0), 4), "filtered")
    want = smooth_numpy(np.array(values[1]), 1.0)
    assert {(r["k"], r["s"]): round(r["filtered"], 9) for r in got if not r["late"]} == {(1, s): round(want[s], 9) for s in range(56)}
    assert [(r["k"], r["s"], r["v"], r["filtered"]) for r in got if r["late"]] == [(1, 5, 9.0, None)]


def test_latch_and_filter_by_group_are_those_of_plain_loops(spark, tmp_path):
    """Names as keys and none, more keys than groups, rows that come late, and values that are NULL."""
    import numpy as np

    rng = np.random.default_rng(4)
    keys = [None, *"abcdefgh"]
    parts = [[(int(k), int(s), None if x < -60 else float(x)) for k, s, x in zip(rng.integers(0, 9, 80), rng.choice(300, 80, replace=False) + 200 * p, rng.normal(0, 40, 80), strict=True)] for p in range(4)]
    names = F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("k") + 1)
    stream = source(spark, tmp_path, parts).select(names.alias("k"), "ts", F.unix_seconds("ts").alias("s"), "v")
    latch, filtered, now, held = [], [], {}, {}
    for part in parts:
        ends, went = {k: now[k][1] for k in now}, {k: held[k][-1][0] for k in held}
        for k, s, x in sorted(part, key=lambda r: r[1]):
            late = s < ends.get(k, s)
            if not late:
                at = now.get(k, (0, 0))[0]
                now[k] = (at if x is None or abs(x) <= 25 else 1 if x > 0 else -1, s)
            latch.append((str(keys[k]), s, None if late else now[k][0], late))
            if s < went.get(k, s):
                filtered.append((str(keys[k]), s, None, True))
            else:
                held.setdefault(k, []).append((s, np.nan if x is None else x))
    three = lambda x: np.convolve(np.pad(x, 1, mode="edge"), [0.25, 0.5, 0.25], "valid")
    for k, rows in held.items():
        made = three(np.array([x for _, x in rows]))
        filtered += [(str(keys[k]), s, None if np.isnan(y) else round(float(y), 9), False) for (s, _), y in zip(rows[:-1], made, strict=False)]
    got = drained(live.latched(stream, "v", 25.0, "k", groups=3), "latch_groups")
    assert sorted(((str(r["k"]), int(r["ts"].timestamp()), r["latch"], r["late"]) for r in got), key=str) == sorted(latch, key=str)
    got = drained(live.halo_filtered(stream, "v", "k", "s", three, 1, groups=3), "filter_groups")
    assert sorted(((str(r["k"]), r["s"], r["filtered"] if r["filtered"] is None else round(r["filtered"], 9), r["late"]) for r in got), key=str) == sorted(filtered, key=str)
    assert any(r[-1] for r in latch) and any(r[-1] for r in filtered)


def arriving(spark, tmp_path, parts):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "k int, i long, v double").select("k", "i", (F.col("i") * 1.0).alias("t"), "v", F.timestamp_seconds("i").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/p={k}")
    return spark.readStream.schema("k int, i long, t double, v double, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def test_two_thresholds_on_a_stream(spark, tmp_path):
    """Samples out of order inside a span, missing samples, NULLs, silences: the batch detector's events."""
    import random

    from tessera.operators import detect
    from tessera.streaming import stateful

    rng = random.Random(8)
    rows = []
    for k in range(3):
        i = k
        while i < 400:
            rows.append((k, i, None if rng.random() < 0.02 else float(rng.choice([0, 0, 1, 2, 2, 3, 4]))))
            i += 1 if rng.random() < 0.95 else rng.choice([2, 3, 5, 60])
    parts = [[r for r in rows if lo <= r[1] < lo + 37] for lo in range(0, 400, 37)]
    for part in parts:
        rng.shuffle(part)
    settings = {"merge_gap": 3.0, "min_duration": 2.0, "max_duration": 12.0, "dt": 1.0}
    stream = arriving(spark, tmp_path, [*parts, [(9, 100_000, 0.0)]])
    found = stateful.two_threshold_events(stream, "k", low=F.lit(2.0), high=F.lit(4.0), idle=20.0, late="40 seconds", **settings)
    got = live.drained(found, f"{tmp_path}/out", f"{tmp_path}/check").collect()
    trace = spark.createDataFrame(rows, "k int, i long, v double").withColumn("t", F.col("i") * 1.0)
    want = detect.two_threshold(trace, ["k"], low=F.lit(2.0), high=F.lit(4.0), **settings).collect()
    shown = lambda x: sorted((r["k"], r["start"], r["peak"], r["end"], r["peak_value"]) for r in x)
    assert shown(got) == shown(want) and len(got) > 20


def test_events_leave_before_the_stream_ends(spark, tmp_path):
    """An event is given as soon as the watermark shows that nothing merges with it any more; its key's state goes when it is idle."""
    from tessera.streaming import stateful

    parts = [[(1, i, v) for i, v in enumerate([0.0, 5.0, 5.0, 0.0, 0.0, 0.0, 0.0])], [(1, i, 0.0) for i in range(7, 12)], [(2, 500, 0.0)], [(1, 600, 5.0), (1, 601, 5.0)], [(2, 5000, 0.0)], [(1, 7, 9.0)]]
    stream = arriving(spark, tmp_path, parts)
    found = stateful.two_threshold_events(stream, "k", low=F.lit(2.0), high=F.lit(4.0), merge_gap=2.0, min_duration=1.0, max_duration=9.0, dt=1.0, idle=50.0)
    with live.set_for_now(spark, stateful.STORE):
        q = found.writeStream.format("memory").queryName("early").outputMode("append").start()
        try:
            q.processAllAvailable()
            assert sorted((r["k"], r["start"], r["end"]) for r in spark.table("early").collect()) == [(1, 1.0, 3.0), (1, 600.0, 602.0)]
            left = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda x: __import__("json").loads(x.json), q.recentProgress) if p["stateOperators"]]
            assert left[-1] < max(left)
        finally:
            q.stop()


def test_a_filter_gives_its_last_samples(spark, tmp_path):
    """Out of order inside a span; the end of a trace and a silence inside it are ends alike; NULLs count as NaN."""
    import numpy as np
    from tessera.streaming import stateful

    rng = np.random.default_rng(5)
    traces = {(1, 0): rng.normal(size=60), (1, 1000): rng.normal(size=9), (2, 3): rng.normal(size=2)}
    rows = [(k, first + j, float(v)) for (k, first), own in traces.items() for j, v in enumerate(own)]
    parts = [[r for r in rows if lo <= r[1] < hi][::-1] for lo, hi in ((0, 25), (25, 26), (26, 500), (500, 2000))]
    out = stateful.filtered(arriving(spark, tmp_path, [*parts, [(9, 100_000, 0.0)]]), "k", lambda x: smooth_numpy(x, 1.0), 4, idle=100.0, late="40 seconds")
    got = {(r["k"], r["i"]): r["filtered"] for r in live.drained(out, f"{tmp_path}/out", f"{tmp_path}/check").where("k < 9").collect()}
    assert len(got) == len(rows)
    for (k, first), own in traces.items():
        assert np.allclose([got[k, first + j] for j in range(len(own))], smooth_numpy(own, 1.0))
