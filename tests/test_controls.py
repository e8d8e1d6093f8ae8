"""Controls, choices and report tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.operators import controls, reports


def test_groups_of_separate_clouds():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (50, 2)) for c in (0, 5, 9)])
    own, other = controls.kmeans_levels(x, x + 0.01, 3, seed=1)
    assert (own == other).all() and [len(set(own[k * 50 : k * 50 + 50])) for k in range(3)] == [1, 1, 1] and len(set(own)) == 3


def test_folds_are_contiguous_blocks(spark):
    df = spark.createDataFrame([("s", k) for k in range(10)], "session string, k int")
    got = [r["fold"] for r in controls.folded(df, ["session"], "k", 3).orderBy("k").collect()]
    cuts = [10 * f // 3 for f in range(4)]
    assert got == [f for f in range(3) for _ in range(cuts[f], cuts[f + 1])]


def test_concentration_of_random_cells(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (20,)], "n_active int")
    got = {r["n_active"]: r["expected"] for r in controls.concentration_null(df, [5, 5, 5, 5]).collect()}
    assert got[1] == 1.0 and got[20] == pytest.approx(0.25)
    assert got[2] == pytest.approx(0.5 + 0.5 * 4 / 19, abs=0.03)  # the second cell is of the first one's group with 4/19


def test_jitter_moves_every_spike_a_little_and_repeats(spark):
    df = spark.createDataFrame([("s", 1, float(k)) for k in range(200)], "session string, cluster_id int, t double")
    a, b = (sorted(r["t"] for r in controls.jittered(df.repartition(n), 0.1, 5, ["session"]).collect()) for n in (1, 7))
    assert a == b and all(abs(x - k) <= 0.1 for k, x in enumerate(a)) and len(set(a)) == 200
    assert abs(np.mean([x - k for k, x in enumerate(a)])) < 0.02


def test_undefined_values_pass_no_criterion(spark):
    df = spark.createDataFrame([(1, 99, 5.0, 0.01, 1, 0.9), (2, 99, 5.0, 0.01, 1, None), (3, 99, None, 0.01, 1, 0.9), (4, 49, 5.0, 0.01, 1, 0.9)], "cluster_id int, n_spikes int, peak_rate double, p double, n_fields int, stability double")
    assert {r["cluster_id"]: r["is_place_cell"] for r in controls.classified(df).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_report_tables(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.5), ("a", 10.0), ("a", 11.0), ("b", float("nan"))], "k string, v double")
    h = {(r["k"], r["bin"]): r["n"] for r in reports.histogram(df, ["k"], "v", 0.0, 10.0, 2).collect()}
    assert h == {("a", 0): 2, ("a", 1): 1, ("b", 0): 0, ("b", 1): 0}
    assert [r["share"] for r in reports.distribution(df, ["k"], "v").where("k = 'a'").orderBy("v").collect()] == [0.25, 0.5, 0.75, 1.0]
    assert reports.normalised(df.where("k = 'a'"), ["k"], "v").agg(F.max("v")).first()[0] == 1.0
    assert {r["share"] for r in reports.shares(df.where("k = 'a'"), ["k"], "v", "v").where("v > 10").collect()} == {11.0 / 21.5}
    assert reports.top(df.where("k = 'a'"), "v", 2).count() == 2
    spikes = spark.createDataFrame([("s", 7, 1.0), ("s", 8, 5.0)], "session string, cluster_id int, t double")
    events = spark.createDataFrame([("s", 1, 0.5, 1.5, 2.0)], "session string, event_id int, start double, peak double, end double")
    assert [tuple(r) for r in reports.rasters(spikes, events, ["session"]).collect()] == [("s", 1, 7, -0.5)]
