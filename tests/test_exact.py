"""Percentiles and filters that are exact however the rows are dealt out."""

from __future__ import annotations

import numpy as np
import pytest
from tessera.functions.signal import band_sections, bandpass
from tessera.operators import filters, percentiles

SHARES = [0.0, 0.013, 0.25, 0.5, 0.77, 0.999, 1.0]


@pytest.mark.parametrize(("parts", "few"), [(16, 5), (1024, 10_000)])
def test_percentiles_like_numpy(spark, parts, few):
    """A hot key, equal values, a skewed spread, one row, NULL keys, both ends of the doubles; NaN and NULL take no part."""
    rng = np.random.default_rng(2)
    data = {"hot": rng.normal(size=3000), "same": np.full(40, 7.5), "skew": 10.0 ** rng.uniform(-300, 300, 60), "one": np.array([3.0]), None: rng.integers(0, 5, 200).astype(float), "ends": np.array([-1.7e308, 1.7e308, 0.0, -0.0, 5e-324])}
    rows = [(k, float(v)) for k, own in data.items() for v in own] + [("hot", float("nan")), ("hot", None), ("hot", float("inf")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r for r in percentiles.exact_percentiles(df, ["k"], "v", SHARES, parts=parts, few=few).collect()}
    assert set(got) == set(data)
    for k, own in data.items():
        if k != "ends":  # numpy overflows between the ends
            assert got[k]["n"] == len(own) and got[k]["percentiles"] == pytest.approx(np.percentile(own, [100 * q for q in SHARES]).tolist(), rel=1e-12)
    assert got["ends"]["percentiles"][0] == -1.7e308 and got["ends"]["percentiles"][-1] == 1.7e308 and got["ends"]["percentiles"][3] == 0.0


def test_percentiles_of_no_rows(spark):
    assert percentiles.exact_percentiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", [0.5]).collect() == []


@pytest.mark.parametrize("chunk", [1, 50, 97, 10_000])
def test_filter_over_chunks_is_the_whole_one(spark, chunk):
    """Traces shorter than the extension, of one chunk and of many; numbering that begins anywhere."""
    rng = np.random.default_rng(chunk)
    sos = band_sections(100.0, (5.0, 11.0), 3)
    traces = {0: (0, rng.normal(size=400)), 1: (-7, rng.normal(size=12)), 2: (10**9, np.cumsum(rng.normal(size=203))), 3: (5, np.array([1.0]))}
    df = spark.createDataFrame([(k, first + j, float(v)) for k, (first, own) in traces.items() for j, v in enumerate(own)], "k int, i long, x double").repartition(4)
    got = {(r["k"], r["i"]): r["x"] for r in filters.zero_phase(df, ["k"], sos, chunk=chunk).collect()}
    for k, (first, own) in traces.items():
        mine = [got.pop((k, first + j)) for j in range(len(own))]
        assert mine == [None] if len(own) == 1 else np.allclose(mine, bandpass(own, 100.0, (5.0, 11.0)), atol=1e-9)
    assert not got


def test_maps_of_chunks_compose(spark):
    sos = band_sections(1250.0, (150.0, 250.0), 2)
    x, rng = np.random.default_rng(3).normal(size=57), np.random.default_rng(4)
    state = rng.normal(size=(2, 2))
    _, after = filters.run_cascade(sos, x, state)
    _, offset = filters.run_cascade(sos, x, np.zeros((2, 2)))
    assert np.allclose(after.ravel(), np.linalg.matrix_power(filters.transition(sos), 57) @ state.ravel() + offset.ravel())


@pytest.mark.parametrize("piece", [None, 0.7, 5.0, 1e6])
def test_asof_in_pieces(spark, piece):
    """Spans without references, without queries, ties in time, keys of one side only, NULL keys."""
    from tessera.operators.asof import asof

    rng = np.random.default_rng(12)
    q = [(k, float(rng.integers(-200, 400)) / 10, i) for i, k in enumerate(rng.choice(["a", "b", None, "q"], 200))]
    r = [(k, float(rng.integers(0, 60)) / 2, i) for i, k in enumerate(rng.choice(["a", "b", None, "r"], 40))] + [("a", 399.0, 99)]
    queries, reference = spark.createDataFrame(q, "k string, t double, id int"), spark.createDataFrame(r, "k string, t double, v int")
    for direction in ("backward", "forward", "nearest"):
        got = {x["id"]: (x["ref_t"], x["v"]) for x in asof(queries, reference, ["k"], values=["v"], direction=direction, piece=piece).collect()}
        for k, t, i in q:
            own = [(abs(t - u), u, v) for kk, u, v in r if kk == k and (u <= t if direction == "backward" else u >= t if direction == "forward" else True)]
            assert got[i] == (min(own)[1:] if own else (None, None)), (direction, k, t)


@pytest.mark.parametrize("piece", [0.5, 3.0, 1e9])
def test_running_sum_in_pieces(spark, piece):
    from tessera.operators.chunks import running_sum

    rng = np.random.default_rng(1)
    rows = [(k, float(rng.integers(-50, 50)) / 4, i, None if i % 9 == 0 else int(rng.integers(-5, 6))) for i, k in enumerate(rng.choice(["a", None], 150))]
    got = {r["id"]: r["s"] for r in running_sum(spark.createDataFrame([*rows, ("a", None, 999, 1)], "k string, t double, id int, x long"), "x", ["k"], ["t", "id"], piece, "s").collect()}
    for k in ("a", None):
        total = 0
        for _, _, i, x in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3]):
            total += x or 0
            assert got.pop(i) == total
    assert not got


# --- table functions -------------------------------------------------------------------------------


def test_sample_windows_from_sql(spark):
    """Keys with too little room, with none, NULL ends, no keys at all; against the rule written out."""
    from tessera.functions import table_functions

    table_functions.register(spark)
    rng = np.random.default_rng(3)
    rows = [(k, float(s), float(s + d)) for k in "abc" for s, d in zip(np.arange(0, 1000, 100), rng.uniform(1, 60, 10), strict=True)] + [("none", 0.0, 5.0), ("exact", 3.0, 13.0), ("a", None, 7.0)]
    spark.createDataFrame(rows, "key string, start double, end double").createOrReplaceTempView("spells")

    def by_rule(own, n, window=10.0):
        fit = sorted((s, e - s - window) for s, e in own if s is not None and e - s >= window)
        total = sum(r for _, r in fit)
        n, out = min(n, int(total // window) + len(fit)), []
        for k in range(n):
            at, before = (k + 0.5) * total / n, 0.0
            for j, (s, room) in enumerate(fit):
                if at < before + room or j == len(fit) - 1:
                    out.append((k, s + at - before))
                    break
                before += room
        return out

    got = spark.sql("SELECT * FROM sample_windows(TABLE(spells), 10.0, 7)").collect()
    for k in ("a", "b", "c", "none", "exact"):
        want = by_rule([r[1:] for r in rows if r[0] == k], 7)
        mine = sorted((r["k"], r["start"]) for r in got if r["key"] == k)
        assert [m[0] for m in mine] == [w[0] for w in want] and np.allclose([m[1] for m in mine], [w[1] for w in want])
    whole = spark.sql("SELECT * FROM sample_windows(TABLE(SELECT start, end FROM spells), 10.0, 50)").collect()
    assert np.allclose(sorted(r["start"] for r in whole), sorted(w[1] for w in by_rule([r[1:] for r in rows], 50)))
    for wrong in ("TABLE(SELECT key, start FROM spells), 10.0, 7", "TABLE(spells), 0.0, 7", "TABLE(spells), 'x', 7"):
        with pytest.raises(Exception, match="numeric column|above 0"):
            spark.sql(f"SELECT * FROM sample_windows({wrong})").collect()


def test_largest_peaks_from_sql(spark):
    from tessera.functions import table_functions

    table_functions.register(spark)
    rng = np.random.default_rng(4)
    rows = [(k, int(i), None if rng.random() < 0.05 else float(rng.integers(0, 9))) for k in ("a", None) for i in range(80)]
    spark.createDataFrame(rows, "k string, i long, v double").createOrReplaceTempView("trace")
    got = {(r["k"], r["rank"]): (r["i"], r["v"]) for r in spark.sql("SELECT * FROM largest_peaks(TABLE(trace), 4, 6)").collect()}
    for k in ("a", None):
        taken = []
        for _, i, v in sorted((r for r in rows if r[0] == k and r[2] is not None), key=lambda r: (-r[2], r[1])):
            if len(taken) < 4 and all(abs(i - j) >= 6 for j, _ in taken):
                taken.append((i, v))
        assert [got.pop((k, n + 1)) for n in range(4)] == taken
    assert not got
