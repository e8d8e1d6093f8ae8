"""Runs, joins, detection and tables against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from tessera.functions.kernels import gaussian_weights, smooth_numpy, smooth_trace, smooth_trace_nan_aware
from tessera.functions import axis as ax
from tessera.operators import asof, chunks, detect, intervals, islands, ranks, validate
from tessera.sources import tables


def runs_of(flags):
    out, start = [], None
    for k, f in enumerate([*flags, False]):
        if f and start is None:
            start = k
        if not f and start is not None:
            out.append((start, k - 1))
            start = None
    return out


@pytest.mark.parametrize("chunk", [None, 7, 1000])
def test_runs(spark, chunk):
    rng = random.Random(4)
    flags = {s: [rng.random() < 0.6 for _ in range(90)] for s in "ab"}
    df = spark.createDataFrame([(s, k, f if rng.random() > 0 else None, float(k)) for s, fs in flags.items() for k, f in enumerate(fs)], "s string, i long, f boolean, v double")
    got = islands.true_runs(df, F.col("f"), ["s"], chunk=chunk, values={"top": ("max", "v")}).collect()
    assert {(r["s"], r["first"], r["last"], r["n"], r["top"]) for r in got} == {(s, a, b, b - a + 1, float(b)) for s, fs in flags.items() for a, b in runs_of(fs)}


def test_bridge_and_drop(spark):
    rng = random.Random(5)
    flags = [rng.random() < 0.5 for _ in range(200)]
    allowed = [rng.random() < 0.8 for _ in range(200)]
    want = list(flags)
    on = runs_of(flags)
    for (_, b), (c, _) in zip(on[:-1], on[1:], strict=True):
        if c - b - 1 <= 2 and all(allowed[b + 1 : c]):
            want[b + 1 : c] = [True] * (c - b - 1)
    for a, b in runs_of(want):
        if b - a + 1 < 3:
            want[a : b + 1] = [False] * (b - a + 1)
    df = spark.createDataFrame([("s", k, f, a) for k, (f, a) in enumerate(zip(flags, allowed, strict=True))], "s string, i long, f boolean, ok boolean")
    out = islands.drop_short_runs(islands.bridge_short_gaps(df, "f", F.col("ok"), ["s"], "i", 2), "f", ["s"], "i", 3)
    assert [r["f"] for r in out.orderBy("i").collect()] == want


@pytest.mark.parametrize("chunk", [None, 11])
def test_two_thresholds_like_a_loop(spark, chunk):
    rng = random.Random(6)
    rows, want = [], set()
    for trace in range(12):
        v = [round(rng.gauss(0, 1) + 2 * (rng.random() < 0.3), 3) for _ in range(120)]
        rows += [(trace, k, k * 0.5, x) for k, x in enumerate(v)]
        strong = [(a, b) for a, b in runs_of([x >= 0.5 for x in v]) if max(v[a : b + 1]) >= 2]
        merged = []
        for a, b in strong:
            if merged and (a - merged[-1][1]) * 0.5 < 1.5:
                merged[-1] = (merged[-1][0], b)
            else:
                merged.append((a, b))
        for a, b in merged:
            if 1.0 <= (b + 1 - a) * 0.5 <= 6.0:
                span = v[a : b + 1]
                want.add((trace, a * 0.5, (a + span.index(max(span))) * 0.5, (b + 1) * 0.5, max(span)))
    df = spark.createDataFrame(rows, "tr int, i long, t double, v double")
    got = detect.two_threshold(df, ["tr"], low=F.lit(0.5), high=F.lit(2.0), merge_gap=1.5, min_duration=1.0, max_duration=6.0, dt=0.5, chunk=chunk)
    assert {tuple(r) for r in got.collect()} == want and want


def test_joins_with_intervals(spark):
    rng = random.Random(7)
    pts = [("s", k, round(rng.uniform(-5, 50), 2)) for k in range(200)] + [("s", 900, 10.0), ("s", 901, 20.0)]
    iv = [("s", k, a, a + rng.choice([0.0, 0.5, 9.0])) for k, a in enumerate([round(rng.uniform(-5, 45), 2) for _ in range(30)])] + [("s", 90, 10.0, 20.0), ("s", 91, 30.0, 29.0)]
    p, v = spark.createDataFrame(pts, "s string, p int, t double"), spark.createDataFrame(iv, "s string, v int, start double, end double")
    for closed in ("left", "both"):
        want = {(a, b) for _, a, t in pts for _, b, lo, hi in iv if lo <= t and (t < hi or (closed == "both" and t == hi))}
        got = intervals.points_in_intervals(p, v, ["s"], closed=closed, width=3.0)
        assert sorted((r["p"], r["v"]) for r in got.collect()) == sorted(want)
    inside = {r["p"] for r in intervals.points_in_intervals(p, v, ["s"], width=3.0, how="left_semi").collect()}
    outside = {r["p"] for r in intervals.points_in_intervals(p, v, ["s"], width=3.0, how="left_anti").collect()}
    assert not inside & outside and len(inside | outside) == len(pts)


def test_overlap_or_near(spark):
    rng = random.Random(8)
    make = lambda n: [("s", k, a, a + d / 3, a + d) for k, (a, d) in enumerate((round(rng.uniform(0, 100), 1), rng.choice([0.5, 2.0, 8.0])) for _ in range(n))]
    a, b = make(40), make(40)
    da, db = (spark.createDataFrame(x, "s string, event_id int, start double, peak double, end double") for x in (a, b))
    want = {(x[1], y[1]) for x in a for y in b if (y[2] < x[4] and y[4] > x[2]) or abs(y[3] - x[3]) <= 1.5}
    got = intervals.overlapping(da, db, ["s"], near=1.5, width=4.0).collect()
    assert sorted((r["event_id_a"], r["event_id_b"]) for r in got) == sorted(want)
    best = {r["event_id"]: r["b_event_id"] for r in detect.compare_events(da, db, ["s"], 1.5, width=4.0).collect()}
    for i, j in best.items():
        assert (abs(b[j][3] - a[i][3]), j) == min((abs(b[k][3] - a[i][3]), k) for x, k in want if x == i)
    s = detect.overlap_summary(da, db, ["s"], 1.5).first()
    assert (s["n_a_matched"], s["n_b_matched"]) == (len({x for x, _ in want}), len({y for _, y in want}))


def test_nearest_within(spark):
    rng = random.Random(9)
    q = [("s", k, rng.randrange(0, 60)) for k in range(60)]
    r = [("s", 1000 + k, rng.randrange(0, 60) * 2) for k in range(12)]
    dq, dr = spark.createDataFrame(q, "s string, q int, t long"), spark.createDataFrame(r, "s string, ref_id int, t long")
    got = {x["q"]: x["ref_id"] for x in detect.nearest_within(dq, dr, ["s"], 3).collect()}
    for _, k, t in q:
        near = min((abs(u - t), u, i) for _, i, u in r)
        assert got[k] == (near[2] if near[0] <= 3 else -1)
    forward = {x["q"]: x["ref_t"] for x in asof.asof(dq, dr, ["s"], values=["ref_id"], direction="forward").collect()}
    backward = {x["q"]: x["ref_t"] for x in asof.asof(dq, dr, ["s"], values=["ref_id"], direction="backward").collect()}
    for _, k, t in q:
        assert forward[k] == min((u for _, _, u in r if u >= t), default=None) and backward[k] == max((u for _, _, u in r if u <= t), default=None)
    plan = detect.nearest_within(dq, dr, ["s"], 3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_smoothing_agrees(spark):
    rng = random.Random(1)
    v = [rng.random() for _ in range(50)]
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(v)], "s string, i long, v double")
    got = [r["smoothed"] for r in smooth_trace(df, "v", ["s"], "i", 2.0).orderBy("i").collect()]
    assert got == pytest.approx(smooth_numpy(v, 2.0).tolist())
    assert sum(gaussian_weights(3.3)) == pytest.approx(1)
    assert smooth_numpy(v * 40, 40.0).tolist()[1000] == pytest.approx(smooth_numpy(v * 40, 40.0, mode="wrap").tolist()[1000])


def test_axis(spark):
    ring, line = ax.cut(0.0, 10.0, 1.0, ring=True), ax.cut(0.0, 2.0, 1.0, ring=False)
    nan = F.lit(float("nan"))
    row = spark.range(1).select(
        ax.way(ring, F.lit(9.0), F.lit(1.0)).alias("d"), ax.way(ring, F.lit(6.0), F.lit(1.0)).alias("half"), ax.way(line, F.lit(0.0), F.lit(2.0)).alias("straight"),
        *(ax.bin_number(a, x).alias(f"{n}{k}") for n, a in (("r", ring), ("l", line)) for k, x in enumerate((F.lit(10.5), F.lit(-0.5), F.lit(2.0), nan, F.lit(None).cast("double")))),
        ax.brought_in(ring, F.lit(-1.0)).alias("in"), ax.brought_in(line, F.lit(-1.0)).alias("out"),
    ).first()
    assert (row["d"], row["half"], row["straight"], row["in"], row["out"]) == (-2.0, -5.0, -2.0, 9.0, -1.0)
    assert [row[f"r{k}"] for k in range(5)] == [0, 9, 2, -1, -1] and [row[f"l{k}"] for k in range(5)] == [1, 0, 1, -1, -1]
    assert ax.cut(0.0, 2.5, 1.0, ring=False).bins == 2 and ax.cut(0.0, 3.5, 1.0, ring=False).bins == 4  # half to even
    assert ax.edges(line) == [0.0, 1.0, 2.0] and ax.centre(line, 1) == 1.5
    rows = spark.createDataFrame([("s", k, x) for k, x in enumerate([None, 8.0, 9.5, 1.0, None, 3.0, 1.0, 9.0])], "s string, i int, x double")
    assert [r["u"] for r in ax.unrolled(ring, rows, "x", ["s"], "i", "u").orderBy("i").collect()] == [None, 8.0, 9.5, 11.0, None, 3.0, 1.0, -1.0]
    with pytest.raises(ValueError):
        ax.spanned(rows.where("x is null"), 1.0, ring=False, x="x")


def test_upsert_rules(spark, tmp_path):
    path = f"{tmp_path}/t"
    make = lambda rows, cols="session string, v int": spark.createDataFrame(rows, cols)
    tables.write_upsert(spark, path, make([("a", 1), ("b", 2)]), ["session"])
    tables.write_upsert(spark, path, make([("b", 3), ("c", 4)]), ["session"])
    assert {tuple(r) for r in tables.read_versioned(spark, path).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    tables.write_upsert(spark, path, make([]), ["session"])
    assert tables.read_versioned(spark, path).count() == 3  # an empty run never empties the table
    tables.write_upsert(spark, path, make([]), ["session"], cleared=make([("a", 0)]))
    assert {r["session"] for r in tables.read_versioned(spark, path).collect()} == {"b", "c"}
    wide = tables.write_upsert(spark, path, make([("d", 1, 2.5)], "session string, v int, w double"), ["session"])
    assert {tuple(r) for r in wide.collect()} == {("b", 3, None), ("c", 4, None), ("d", 1, 2.5)}
    assert tables.upserted(make([(1,)], "x int"), make([("z", 9)]), ["session"]).count() == 1  # replaced as a whole


def test_a_crash_leaves_the_newest_whole_version(spark, tmp_path):
    path, make = f"{tmp_path}/t", lambda rows: spark.createDataFrame(rows, "k string, v int")
    assert tables.read_versioned(spark, path) is None
    first = tables.write_upsert(spark, path, make([("a", 1)]), ["k"])
    half = tmp_path / "t" / "version-00000001"  # a writer that died: files, but no mark
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"cut off")
    assert tables.versions(spark, path) == [0] and tables.read_versioned(spark, path).collect() == [("a", 1)]
    second = tables.write_upsert(spark, path, make([("b", 2)]), ["k"])
    assert tables.versions(spark, path) == [0, 1] and {tuple(r) for r in second.collect()} == {("a", 1), ("b", 2)}
    assert first.collect() == [("a", 1)]  # who reads the version before still can
    tables.write_upsert(spark, path, make([("a", 3)]), ["k"])
    assert tables.versions(spark, path) == [1, 2]

    failing = make([("z", 1)]).withColumn("v", F.raise_error(F.lit("boom")).cast("int"))
    with pytest.raises(Exception, match="boom"):
        tables.write_upsert(spark, path, failing, ["k"])
    assert {tuple(r) for r in tables.read_versioned(spark, path).collect()} == {("a", 3), ("b", 2)}


def test_csv_tables(spark, tmp_path):
    rows = [("b", 1, 0.5, 'say "x", y'), ("a", None, None, ""), ("a", 2, float("nan"), None), ("c", 3, 1e-300, "zwei\tWörter")]
    schema = "s string, n long, x double, note string"
    tables.write_csv(spark.createDataFrame(rows, schema), f"{tmp_path}/c", ["s", "n"])
    back = tables.read_csv(spark, f"{tmp_path}/c", schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, spark.createDataFrame(rows, schema).collect()))
    for wrong in ("s string, n long, x double", "s string, n double, x long, note string", "s string, m long, x double, note string"):
        with pytest.raises(Exception):  # noqa: B017
            tables.read_csv(spark, f"{tmp_path}/c", wrong).collect()


def test_listing_of_recordings(spark, tmp_path):
    for name in ("a.x.mat", "deep/er/b.mat", "deep/c.txt"):
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_bytes(b"12345")
    assert {(r["session"], r["bytes"]) for r in tables.list_recordings(spark, f"{tmp_path}/r", "*.mat").collect()} == {("a", 5), ("b", 5)}


def test_nearest_vectors_in_blocks(spark):
    from tessera.plans.statistics import nearest_vectors

    rng = random.Random(9)
    rows = lambda n: [(i, [rng.randrange(6) for _ in range(4)]) for i in range(n)]
    test, train = rows(60), rows(90)
    got = {(r["i"], r["j"], r["d"]) for r in nearest_vectors(spark.createDataFrame(test, "i long, v array<long>"), spark.createDataFrame(train, "j long, w array<long>"), block=25).collect()}
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    assert got == {(i, *min((far(v, w), j) for j, w in train)[::-1]) for i, v in test}


def test_small_p_values_never_read_zero(spark):
    row = tables.rounded(spark.createDataFrame([(1.23456789e-7, 2.000005)], "p double, x double"), significant_columns=("p",)).first()
    assert row["p"] == 1.23e-7 and row["x"] == pytest.approx(2.00000, abs=1e-5)


def test_rank_tests_against_loops(spark):
    rng = random.Random(2)
    rows = [(g, float(rng.randrange(8)) if rng.random() > 0.05 else float("nan")) for g in "xy" for _ in range(40)]
    df = spark.createDataFrame(rows, "g string, v double")
    x, y = ([v for g, v in rows if g == k and v == v] for k in "xy")
    u = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
    got = ranks.mann_whitney(df, [], "g", "v", "x", "y").first()
    assert got["u"] == u and got["rank_biserial"] == pytest.approx(2 * u / len(x) / len(y) - 1)
    share = ranks.exceedance_share(df, [], "g", "v", "x", "y").first()["share"]
    assert share == pytest.approx(sum(a >= b for a in x for b in y) / len(x) / len(y))
    d = ranks.ks_statistic(df, [], "g", "v", "x", "y").first()["d"]
    assert d == pytest.approx(max(abs(sum(a <= t for a in x) / len(x) - sum(b <= t for b in y) / len(y)) for t in {*x, *y}))
    assert ranks.exact_u_p(0, 3, 3) == pytest.approx(0.1) and ranks.exact_u_p(4.5, 3, 3) == 1.0
    assert ranks.ks_p(0.0, 5, 5) == 1.0 and ranks.ks_p(1.0, 50, 50) < 1e-10
    p = spark.createDataFrame([(0.0, 3, 3, None, False), (30.0, 20, 20, 4.0, True), (1.0, 0, 3, None, False)], "u double, n1 int, n2 int, z double, t boolean")
    assert [round(r[0], 6) if r[0] is not None else None for r in p.select(ranks.mann_whitney_p("u", "n1", "n2", "z", "t")).collect()] == [0.1, 0.000063, None]


def test_halves_and_p(spark):
    df = spark.createDataFrame([("k", i, float(i % 3)) for i in range(9)], "k string, id int, v double")
    half = {r["id"]: r["half"] for r in ranks.equal_halves(df, ["k"], "v", "id").collect()}
    assert half == {0: "low", 3: "low", 6: "low", 1: "low", 7: "high", 2: "high", 5: "high", 8: "high"}
    a = ranks.random_halves(df, ["k"], "id", 1)
    assert ranks.split_agreement(a, a.withColumn("half", F.when(F.col("half") == "low", "high").otherwise("low")), ["k"], "id").first()["agreement"] == 1.0
    draws = spark.createDataFrame([("a", 2.0, 1.0), ("a", 2.0, -3.0), ("a", 2.0, float("nan")), ("b", float("nan"), 1.0)], "k string, o double, d double")
    assert {r["k"]: r["p"] for r in ranks.empirical_p(draws, ["k"], "o", "d").collect()} == {"a": 2 / 3, "b": None}
    sub = ranks.subsampled(df, ["k"], "id", F.lit(4), 3, 7)
    assert {r["count"] for r in sub.groupBy("draw").count().collect()} == {4}


def test_windows_and_budget(spark):
    iv = spark.createDataFrame([("s", 0.0, 10.0), ("s", 20.0, 22.0), ("s", 30.0, 60.0)], "s string, start double, end double")
    w = detect.sample_windows(iv, ["s"], 5.0, 6).orderBy("k").collect()
    assert len(w) == 6 and all(r["end"] - r["start"] == pytest.approx(5) and (0 <= r["start"] <= 5 or 30 <= r["start"] <= 55) for r in w)
    assert detect.within_budget(iv, ["s"], 12.0).count() == 2 and detect.within_budget(iv, ["s"], 1.0).count() == 1


@pytest.mark.parametrize("chunk", [7, 64])
def test_chunked_windows_are_the_whole_ones(spark, chunk):
    rng = random.Random(chunk)
    rows = [(s, k, None if rng.random() < 0.1 else rng.gauss(0, 1), k * 0.1 + rng.random() * 0.01) for s in ("a", None) for k in range(-20, 130)]
    df = spark.createDataFrame(rows, "s string, i long, v double, t double")
    whole = df.withColumn("g", islands.gradient(F.col("v"), F.col("t"), ["s"], "i")).withColumn("h", islands.hysteresis(F.col("v"), 1.5, ["s"], "i"))
    whole = smooth_trace_nan_aware(whole, "v", ["s"], "i", 1.2, out="m")
    cut = chunks.over_chunks(df, lambda r, keys: smooth_trace_nan_aware(r.withColumn("g", islands.gradient(F.col("v"), F.col("t"), keys, "i")), "v", keys, "i", 1.2, out="m"), ["s"], "i", chunk, 5)
    cut = chunks.latched(cut, F.col("v"), 1.5, ["s"], "i", chunk, "h")
    told = lambda d: [tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r) for r in d.select("s", "i", "v", "t", "g", "m", "h").orderBy("s", "i").collect()]
    assert told(cut) == told(whole)


def test_a_latch_over_chunks_without_a_mark(spark):
    df = spark.createDataFrame([(k, 9.0 if k == 3 else 0.0) for k in range(40)], "i long, v double")
    assert [r["h"] for r in chunks.latched(df, F.col("v"), 1.0, [], "i", 5, "h").orderBy("i").collect()] == [0] * 3 + [1] * 37


def test_reversed_intervals_have_no_partner(spark):
    a = spark.createDataFrame([("s", 10.0, 5.0, 7.0), ("s", 1.0, 2.0, 1.5)], "session string, start double, end double, peak double")
    b = spark.createDataFrame([("s", 1.5, 12.0, 3.0)], a.schema)
    assert {r["start_a"] for r in intervals.overlapping(a, b, ["session"]).collect()} == {1.0}
    assert {r["start"] for r in intervals.overlapping(a, b, ["session"], near=9.0, how="left_anti").collect()} == {10.0}


def test_claims(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert validate.insist(df.where("x > 0"), positive=F.col("x") > 0).count() == 2
    for broken in (df, df.where("x = 1")):
        with pytest.raises(Exception, match="does not hold: large"):
            validate.insist(broken, positive=F.lit(True), large=F.col("x") > 1).collect()
