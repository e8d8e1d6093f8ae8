"""Numeric kernels, recordings on disk, and the recording pipeline on generated data."""

from __future__ import annotations

import itertools
import io
import math
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.functions import axis as ax
from tessera.functions import signal
from tessera.operators import decode, envelopes, fields, movement, sequences, states, validate
from tessera.sources import archives, frames, parameters, synthetic

XML = """<parameters><acquisitionSystem><nBits>16</nBits><nChannels>6</nChannels><samplingRate>20000</samplingRate><voltageRange>20</voltageRange><amplification>400</amplification></acquisitionSystem>
<fieldPotentials><lfpSamplingRate>1250</lfpSamplingRate></fieldPotentials>
<anatomicalDescription><channelGroups><group><channel skip="0">0</channel><channel skip="1">1</channel></group><group><channel skip="0">2</channel><channel skip="0">3</channel></group></channelGroups></anatomicalDescription>
<spikeDetection><channelGroups><group><channels><channel>0</channel><channel>1</channel></channels></group><group><channels><channel>3</channel><channel>2</channel></channels></group></channelGroups></spikeDetection></parameters>"""


# --- filters ---------------------------------------------------------------------------------------


def gain(hz: float, band=(150.0, 300.0), rate=1250.0) -> float:
    t = np.arange(8000) / rate
    x = np.sin(2 * np.pi * hz * t)
    y = signal.bandpass(x, rate, band)[2000:6000]
    return float(np.sqrt(2 * (y**2).mean()))


def test_band_pass_gain():
    assert gain(math.sqrt(150 * 300)) == pytest.approx(1, abs=0.02)
    assert gain(150) == pytest.approx(0.5, abs=0.03) and gain(300) == pytest.approx(0.5, abs=0.03)  # half power, twice
    assert gain(40) < 0.002 and gain(560) < 0.01
    with pytest.raises(ValueError):
        signal.bandpass(np.zeros(100), 500.0, (150.0, 300.0))


def test_filter_has_no_phase_and_works_along_time():
    x = np.zeros(2001)
    x[1000] = 1
    y = signal.bandpass(x, 1250.0, (150.0, 300.0))
    assert np.allclose(y[600:1000], y[1400:1000:-1], atol=1e-9)
    two = np.stack([x, 2 * x], axis=1)
    assert np.allclose(signal.bandpass(two, 1250.0, (150.0, 300.0))[:, 1], 2 * y)


def test_amplitude_of_a_tone():
    t = np.arange(1000) / 1000
    assert np.allclose(signal.analytic_amplitude(3 * np.cos(2 * np.pi * 50 * t)), 3, atol=1e-9)
    assert signal.top_peaks(np.array([1.0, 5, 4, 0, 3, 5]), 1.0, 3, 2.0) == [1, 5, 3]


def test_envelope_chunks_do_not_show(spark):
    x = synthetic.pink_with_bursts(4000, 2, 1250.0, [1.0, 2.0], 0)
    df = spark.createDataFrame([("s", k, [int(v) for v in row]) for k, row in enumerate(x)], "session string, i long, values array<smallint>")
    run = lambda chunk: np.array([r["v"] for r in envelopes.channel_envelope(df, [0], rate_hz=1250.0, band=(150.0, 300.0), sigma_ms=8.0, chunk=chunk, halo=512).orderBy("i").collect()])
    whole, cut = run(1 << 20), run(1000)
    assert len(cut) == 4000 and np.abs(whole - cut).max() < 0.02 * whole.max()
    assert abs(int(whole.argmax()) / 1250 % 1.0) < 0.03 or abs(int(whole.argmax()) / 1250 % 1.0 - 1) < 0.03


def test_a_chunk_that_is_all_halo(spark):
    """91 samples in chunks of 100 with a halo of 10: the second chunk gets one sample, of the first one's halo."""
    df = spark.createDataFrame([("s", k, [k % 7]) for k in range(91)], "session string, i long, values array<smallint>")
    assert envelopes.channel_envelope(df, [0], rate_hz=1250.0, band=(150.0, 300.0), chunk=100, halo=10).count() == 91


def test_planted_bursts_are_found_with_their_channels(spark):
    x = synthetic.pink_with_bursts(6000, 3, 1250.0, [1.0, 3.0], 1)
    df = spark.createDataFrame([("s", k, [int(v) for v in row]) for k, row in enumerate(x)], "session string, i long, values array<smallint>")
    profile = envelopes.channel_profile(df, [0, 1, 2], {"ripple": (150.0, 300.0)}, rate_hz=1250.0)
    channels = spark.createDataFrame([("s", 1, c, c, False) for c in range(3)], "session string, shank int, channel int, pos int, skip boolean")
    assert envelopes.select_per_group(profile, channels, ["session"], "p99").first()["channel"] == 1
    events = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 2.0), ("s", 3, 3.0)], "session string, event_id int, peak double")
    base = profile.select("session", "channel", F.col("mean"), F.col("mean").alias("sd"))
    z = envelopes.windowed_peak_z(df, events, base, rate_hz=1250.0, band=(150.0, 300.0))
    got = {r["event_id"]: r["n_supporting"] for r in envelopes.shank_support(z, ["session", "event_id"], 3.0).collect()}
    assert got[1] >= 1 and got[3] >= 1 and got[2] == 0
    env = envelopes.channel_envelope(df, [1], rate_hz=1250.0, band=(150.0, 300.0))
    top = envelopes.largest_peaks(env, ["session"], rate_hz=1250.0, n=2, refractory_s=0.5).collect()
    assert sorted(round(r["i"] / 1250) for r in top) == [1, 3]


# --- state models ----------------------------------------------------------------------------------

TINY = states.StateModel(0.25, np.array([[4.0, 1.0], [1.0, 6.0]]), np.array([[0.7, 0.3], [0.4, 0.6]]), np.array([0.6, 0.4]))


def by_paths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """State weights, expected transitions and log likelihood from every path there is."""
    log_b = states.log_emissions(x, TINY.rates, TINY.bin_s)
    paths = {p: math.log(TINY.initial[p[0]]) + sum(math.log(TINY.transition[a, b]) for a, b in itertools.pairwise(p)) + sum(log_b[k, s] for k, s in enumerate(p)) for p in itertools.product((0, 1), repeat=len(x))}
    total = math.log(sum(math.exp(v) for v in paths.values()))
    gamma, moves = np.zeros((len(x), 2)), np.zeros((2, 2))
    for p, v in paths.items():
        for k, s in enumerate(p):
            gamma[k, s] += math.exp(v - total)
        for a, b in itertools.pairwise(p):
            moves[a, b] += math.exp(v - total)
    return gamma, moves, total


def test_expectations_against_all_paths():
    rng = np.random.default_rng(4)
    seqs = [rng.poisson(1.0, (n, 2)).astype(float) for n in (2, 5, 9, 3, 1)]
    counts, lengths = states.padded(seqs)
    weights, moves, total = states.expected(states.log_emissions(counts, TINY.rates, TINY.bin_s), lengths, TINY)
    alone = [by_paths(s) for s in seqs]
    assert np.allclose(total, [ll for _, _, ll in alone]) and np.allclose(moves, sum(xi for _, xi, _ in alone))
    for k, (gamma, _, _) in enumerate(alone):
        assert np.allclose(weights[k, : len(gamma)], gamma) and not weights[k, len(gamma) :].any() and np.allclose(states.posterior(TINY, seqs[k]), gamma)
    assert states.sequence_log_likelihood(TINY, [*seqs, np.zeros((0, 2))]) == pytest.approx(total.sum())
    assert np.allclose(states.sums_of(seqs, TINY), states.sums_of(seqs, TINY, most=1))
    with pytest.raises(ValueError, match="no path"):
        states.sums_of([np.array([[1.0, np.inf]])], TINY)
    with pytest.raises(ValueError, match="two bins"):
        states.fit_here([np.zeros((1, 2))], 2, 0.1)


def test_fits_by_sums_are_those_of_one_task(spark):
    """Sequences of two recordings over many partitions, folds, sizes and seeds in one grid, against fits of lists."""
    rng = np.random.default_rng(8)
    seqs = {k: [rng.poisson(rng.choice([0.3, 3.0], (1, 4)), (int(rng.integers(1, 14)), 4)).astype(float) for _ in range(n)] for k, n in (("a", 9), ("b", 4))}
    rows = [(k, 100 - i, own[i].tolist()) for k, own in seqs.items() for i in range(len(own))]
    df = spark.createDataFrame(rows, "session string, sequence int, counts array<array<double>>").repartition(5)
    grid = [(k, m, seed, fold, 3) for k in seqs for m in (2, 3) for seed in (0, 1) for fold in (-1, 0, 2)] + [("none", 2, 0, -1, 3)]
    got = states.fit_models(df, spark.createDataFrame(grid, "session string, n_states int, seed int, fold int, n_folds int"), bin_s=0.25, key=["session"], iterations=7, tol=1e-4).collect()
    assert len(got) == len(grid) - 1
    for r in got:
        own = seqs[r["session"]][::-1]  # in the order of their numbers
        cuts = np.linspace(0, len(own), 4).astype(int)
        out = set(range(cuts[r["fold"]], cuts[r["fold"] + 1])) if r["fold"] >= 0 else set()
        want = states.fit_here([s for i, s in enumerate(own) if i not in out], r["n_states"], 0.25, seed=r["seed"], iterations=7, tol=1e-4)
        assert (r["n_iterations"], r["converged"]) == (want.rounds, want.converged) and r["log_likelihood"] == pytest.approx(want.ll)
        assert np.allclose(r["rates"], want.model.rates) and np.allclose(r["transition"], want.model.transition) and np.allclose(r["initial"], want.model.initial)
        assert r["held_out_ll"] == pytest.approx(states.sequence_log_likelihood(want.model, [own[i] for i in sorted(out)]))


def test_events_as_sequences_of_states(spark):
    """Posteriors of each bin's counts alone, states in the asked order; scored like any other posterior."""
    rng = np.random.default_rng(3)
    fits = [("a", rng.uniform(1, 9, (3, 4)), rng.dirichlet(np.ones(3), 3), [2.0, None, 1.0]), ("b", rng.uniform(1, 9, (2, 4)), np.full((2, 2), 0.5), [0.0, 1.0])]
    events = {i: rng.poisson(1.0, (6, 4)).astype(float) for i in (4, 7)}
    df = spark.createDataFrame([(i, list(range(6)), n.tolist()) for i, n in events.items()], "event_id long, tbins array<int>, counts array<array<double>>")
    models = spark.createDataFrame([(k, r.tolist(), t.tolist(), p) for k, r, t, p in fits], "fit string, rates array<array<double>>, transition array<array<double>>, positions array<double>")
    for ordering in ("spectral", "position"):
        got = {r["score_id"]: r for r in states.state_events(df, models, bin_s=0.5, ordering=ordering).collect()}
        assert set(got) == {f"{k}:{i}" for k in "ab" for i in events}
        for k, rates, transition, positions in fits:
            order = states.spectral_order(transition) if ordering == "spectral" else sorted(range(len(positions)), key=lambda s: (positions[s] is None, positions[s] or 0))
            for i, n in events.items():
                e = np.exp(n @ np.log(rates * 0.5).T - rates.sum(axis=1) * 0.5)
                assert np.allclose(got[f"{k}:{i}"]["posteriors"][0], (e / e.sum(axis=1, keepdims=True))[:, order].ravel())
    rows = sequences.score_events(states.state_events(df, models, bin_s=0.5), circular=False, n_shuffles=5, id="score_id").collect()
    assert {r["score_id"] for r in rows} == set(got)


def test_rolled_cells_keep_their_counts(spark):
    df = spark.createDataFrame([(c, i, float(i % 5), 40) for c in range(3) for i in range(40)], "cell int, i long, n double, n_bins int")
    moved = {}
    for r in states.rolled_cells(df, [], "cell", "i", "n_bins", 2).collect():
        moved.setdefault(r["cell"], {})[r["i"]] = r["n"]
    starts = {c: [k for k in range(40) if all(own[(k + j) % 40] == j % 5 for j in range(40))] for c, own in moved.items()}
    assert all(starts.values()) and len({tuple(s) for s in starts.values()}) > 1


def test_fit_climbs_and_orders_a_ring():
    rng = np.random.default_rng(1)
    rates = np.array([[20.0 if c // 2 == s else 0.2 for c in range(8)] for s in range(4)])
    move = np.full((4, 4), 0.0)
    for s in range(4):
        move[s, s], move[s, (s + 1) % 4], move[s, (s - 1) % 4] = 0.6, 0.2, 0.2
    seqs = []
    for _ in range(6):
        s, rows = 0, []
        for _ in range(120):
            rows.append(rng.poisson(rates[s] * 0.25))
            s = rng.choice(4, p=move[s])
        seqs.append(np.array(rows))
    begun, climbed = (states.fit_here(seqs, 4, 0.25, seed=2, iterations=n) for n in (2, 60))
    few, many = begun.model, climbed.model
    assert climbed.ll >= begun.ll and np.allclose(many.transition.sum(axis=1), 1)
    assert states.sequence_log_likelihood(many, seqs) >= states.sequence_log_likelihood(few, seqs) - 1
    assert sorted(states.spectral_order(many.transition)) == [0, 1, 2, 3]
    flat = states.memoryless_posterior(many, seqs[0], 0.25)
    assert np.allclose(flat.sum(axis=1), 1) and (states.posterior(many, seqs[0]).argmax(axis=1) == flat.argmax(axis=1)).mean() > 0.8
    assert np.allclose(states.sticky_transition(3, 1.0, 0.25).diagonal(), 0.75) and states.uniform_transition(2).tolist() == [[0.5, 0.5]] * 2
    assert (np.sort(states.roll_cells(seqs[0], rng), axis=0) == np.sort(seqs[0], axis=0)).all()
    assert states.random_rates("marginal", seqs[0], 5, 0.25, rng).shape == (5, 8) and states.stickiness(many)["max_stay"] <= 1


# --- fields, decoding, sequences -------------------------------------------------------------------


def column(spark, expr, **arrays):
    rows = [tuple([None if v is None else float(v) for v in a] for a in arrays.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{k} array<double>" for k in arrays))
    return df.select(expr.alias("x")).first()["x"]


def test_information_of_known_maps(spark):
    one = [0.0] * 7 + [8.0]
    assert column(spark, fields.skaggs_information(F.col("r"), F.col("o")), r=one, o=[1.0] * 8) == pytest.approx(3)
    assert column(spark, fields.skaggs_information(F.col("r"), F.col("o")), r=[2.0] * 8, o=[1.0] * 8) == pytest.approx(0)
    assert column(spark, fields.skaggs_information(F.col("r"), F.col("o")), r=[0.0] * 8, o=[1.0] * 8) is None
    assert column(spark, fields.mean_rate(F.col("r"), F.col("o")), r=[1.0, 3.0, None], o=[1.0, 3.0, 9.0]) == pytest.approx(2.5)
    assert column(spark, fields.peak_bin(F.col("r")), r=[None, 2.0, 5.0, 5.0]) == 2


def test_fields_on_line_and_ring(spark):
    r = [9.0, 9, 0, 0, 5, 5, 5, 0, 0, 9]
    ring = column(spark, fields.find_fields(F.col("r"), 10), r=r)
    line = column(spark, fields.find_fields(F.col("r"), 10, circular=False), r=r)
    assert {(x["first"], x["n"]) for x in ring} == {(9, 3), (4, 3)}
    assert {(x["first"], x["n"]) for x in line} == {(0, 2), (4, 3), (9, 1)}
    assert [tuple(x) for x in column(spark, fields.find_fields(F.col("r"), 3), r=[1.0, 1.0, 1.0])] == [(0, 3)]
    assert column(spark, fields.find_fields(F.col("r"), 3), r=[0.0, 0.0, 0.0]) == []
    assert column(spark, fields.find_fields(F.col("r"), 10, max_bins=2), r=r) == []


def test_pearson_guards(spark):
    f = fields.pearson(F.col("a"), F.col("b"))
    assert column(spark, f, a=[1.0, 2, 3, None], b=[2.0, 4, 6, 1]) == pytest.approx(1)
    assert column(spark, f, a=[1.0, 1, 1], b=[1.0, 2, 3]) is None and column(spark, f, a=[1.0, 2, None], b=[1.0, 2, 3]) is None


def test_left_out_group_never_counts(spark):
    df = spark.createDataFrame([("c", g, float(g)) for g in range(5)], "c string, g int, n double")
    assert {r["g"]: r["n"] for r in decode.leave_one_group_out(df, ["c"], "g", ["n"]).collect()} == {g: 10.0 - g for g in range(5)}


def test_posterior_forms_agree(spark):
    rng = np.random.default_rng(0)
    tuning = rng.gamma(1.0, 5.0, (5, 7))
    counts = rng.poisson(1.0, (6, 5))
    long = spark.createDataFrame([(k, "t", c, int(n)) for k, row in enumerate(counts) for c, n in enumerate(row)], "k int, tpl string, cell int, n int")
    rates = spark.createDataFrame([("t", c, b, float(tuning[c, b])) for c in range(5) for b in range(7)], "tpl string, cell int, bin int, rate double")
    lp = decode.log_posterior(long, rates, ["k"], ["tpl"], 0.25)
    got = {(r["k"], r["bin"]): math.exp(r["lp"]) for r in lp.collect()}
    dense = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(counts)], "k int, n array<double>")
    for r in decode.posterior_arrays(dense, tuning, 0.25).collect():
        if counts[r["k"]].sum():
            assert [got[r["k"], b] for b in range(7)] == pytest.approx(list(r["posterior"]))
    modes = {r["k"]: r["decoded"] for r in decode.posterior_mode(lp, ["k"]).collect()}
    assert all(abs(got[k, b] - max(got[k, c] for c in range(7))) < 1e-12 for k, b in modes.items())


def test_weighted_correlation_forms_agree(spark):
    rng = np.random.default_rng(2)
    p = rng.random((4, 6, 8))
    p[0] = np.eye(8)[:6]
    df = spark.createDataFrame([(e, t, b, float(p[e, t, b])) for e in range(4) for t in range(6) for b in range(8)], "e int, tbin int, pbin int, p double")
    for circular in (False, True):
        got = {r["e"]: (r["r"], r["offset"]) for r in sequences.weighted_correlation(df, ["e"], n_bins=8, circular=circular).collect()}
        r, off = sequences.best_correlation(p, np.arange(8.0), np.arange(6.0), circular)
        assert [got[e][0] for e in range(4)] == pytest.approx(r.tolist())
        if not circular:
            assert got[0][0] == pytest.approx(1)
    flat = np.ones((1, 5, 8)) / 8
    assert sequences.best_correlation(flat, np.arange(8.0), np.arange(5.0), False)[0][0] == 0


def test_shuffles_keep_columns(spark):
    rng = np.random.default_rng(0)
    p = rng.random((2, 5, 8))
    for kind in sequences.SHUFFLES:
        s = sequences.shuffled(p, kind, 7, np.random.default_rng(1))
        assert s.shape == (7, 2, 5, 8) and np.allclose(np.sort(s.sum(axis=-1)), np.sort(np.broadcast_to(p.sum(axis=-1), (7, 2, 5))))
    with pytest.raises(ValueError):
        sequences.shuffled(p, "none", 1, rng)
    ridge = np.exp(-0.5 * ((np.arange(32)[None] - (4 + 3 * np.arange(8))[:, None]) / 1.0) ** 2)
    flat = (ridge / ridge.sum(axis=1, keepdims=True)).ravel().tolist()
    events = spark.createDataFrame([(1, list(range(8)), [flat]), (2, [0, 1], [flat[:64]])], "event_id long, tbins array<int>, posteriors array<array<double>>")
    rows = sequences.score_events(events, circular=False, n_shuffles=100).collect()
    assert len(rows) == 1 and rows[0]["r"] > 0.95 and rows[0]["rz"] > 2


# --- recordings ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def rec(spark):
    return synthetic.recording(spark)


def codes(rec, spark, **changed):
    t = rec | changed
    return {(r["severity"], r["code"]) for r in validate.validate(t["sessions"], t["spikes"].withColumn("seq", F.monotonically_increasing_id()), t["units"], t["epochs"], t["position"], t["states"].withColumn("seq", F.col("start")), ["Wake", "Drowsy", "NREM", "Intermediate", "REM"]).collect()}


def test_clean_recording_and_mutations(rec, spark):
    clean = codes(rec, spark)
    assert {s for s, _ in clean} == {"info"} and ("info", "position_dt") in clean
    s = rec["spikes"]
    extra = lambda t: s.unionByName(spark.createDataFrame([(synthetic.NAME, 102, t)], s.schema))
    assert ("warning", "spikes_after_session_end") in codes(rec, spark, spikes=extra(400.0))
    assert ("error", "spike_times_nonfinite") in codes(rec, spark, spikes=extra(float("nan")))
    assert ("warning", "spikes_before_session_start") in codes(rec, spark, spikes=extra(-3.0))
    u = rec["units"]
    assert ("error", "pyr_int_overlap") in codes(rec, spark, units=u.unionByName(u.where("cluster_id = 102").withColumn("kind", F.lit("int"))))
    assert ("error", "pyr_ids_duplicates") in codes(rec, spark, units=u.unionByName(u.where("cluster_id = 102")))
    assert ("warning", "unclassified_clusters") in codes(rec, spark, units=u.where("cluster_id <> 102"))
    e = rec["epochs"]
    assert ("error", "epochs_overlap") in codes(rec, spark, epochs=e.withColumn("end", F.col("end") + F.when(F.col("epoch") == "PRE", 5.0).otherwise(0.0)))
    assert ("info", "epoch_gap") in codes(rec, spark, epochs=e.withColumn("end", F.col("end") - F.when(F.col("epoch") == "PRE", 5.0).otherwise(0.0)))
    p = rec["position"]
    assert ("error", "position_1d_all_nan") in codes(rec, spark, position=p.withColumn("x1d", F.lit(None).cast("double")))
    assert ("warning", "position_1d_out_of_track") in codes(rec, spark, position=p.withColumn("x1d", F.col("x1d") * 2))
    assert ("error", "position_too_short") in codes(rec, spark, position=p.where("sample = 0"))
    st = rec["states"]
    assert ("info", "state_empty") in codes(rec, spark, states=st.where("state <> 'REM'"))
    assert ("warning", "states_overlap") in codes(rec, spark, states=st.unionByName(spark.createDataFrame([(synthetic.NAME, "REM", 5.0, 8.0)], st.schema)))
    assert ("error", "state_negative_length") in codes(rec, spark, states=st.unionByName(spark.createDataFrame([(synthetic.NAME, "REM", 99.0, 98.0)], st.schema)))


@pytest.mark.parametrize(("kind", "low", "high", "want"), [("linear", -0.5, 1.0, {"position_1d_out_of_track"}), ("linear", 0.0, 9.0, {"position_1d_out_of_track"}), ("circular", -0.5, 9.0, {"position_1d_negative"}), ("circular", 0.0, 9.0, set()), (None, 0.0, 1.0, set())])
def test_range_of_position_by_maze_kind(rec, spark, kind, low, high, want):
    """Below zero a linear track is left, a circular one numbered wrongly; only a linear one has an end."""
    sessions = rec["sessions"].withColumns({"maze_kind": F.lit(kind).cast("string"), "track_length_m": F.lit(1.6)})
    position = rec["position"].withColumn("x1d", F.when(F.col("sample") % 2 == 0, F.lit(low)).otherwise(F.lit(high)))
    found = {c for _, c in codes(rec, spark, sessions=sessions, position=position)}
    assert found & {"position_1d_out_of_track", "position_1d_negative"} == want and "position_nan" in found


def test_truncation(rec, spark):
    s = rec["spikes"].unionByName(spark.createDataFrame([(synthetic.NAME, 102, 300.0), (synthetic.NAME, 103, 310.5)], rec["spikes"].schema))
    kept, _, _, report = validate.truncate(s, rec["states"], rec["epochs"], rec["sessions"])
    r = report.first()
    assert kept.count() == s.count() - 1 and (r["n_dropped"], r["n_clusters"], r["seconds_beyond"]) == (1, 1, 10.5)


def test_running_in_chunks(rec):
    run = lambda chunk: [(r["sample"], r["running"], r["speed"] and round(r["speed"], 6)) for r in movement.running_mask(rec["position"], dt=0.0256, chunk=chunk).select("sample", "running", "speed").orderBy("sample").collect()]
    assert run(300) == run(None)


def test_laps_and_running(rec):
    track = ax.spanned(rec["position"], 0.1, ring=False)
    run = movement.running_mask(rec["position"], dt=0.0256)
    s = movement.running_summary(run, 0.0256).first()
    assert 0 < s["n_running"] < s["n_base"] and s["median_speed"] > 15
    laps = movement.segment_laps(rec["position"], track, dt=0.0256)
    by = {r["direction"]: r["n_laps"] for r in movement.lap_summary(laps).collect()}
    assert 10 <= sum(by.values()) <= 13 and abs(by["pos"] - by["neg"]) <= 1
    assert all(r["coverage"] >= 0.5 for r in laps.collect())
    own = movement.linearize_2d(rec["position"], "linear")
    fit = movement.affine_fit(own.select("session", "sample", F.col("x1d").alias("a")).join(rec["position"].select("session", "sample", "x1d"), ["session", "sample"]), ["session"], "x1d", "a").first()
    assert fit["slope"] == pytest.approx(1) and fit["max_residual"] < 1e-9
    assert movement.coverage(rec["position"]).first()["share_2d"] > movement.coverage(rec["position"]).first()["share_1d"]


def test_place_cell_is_found(rec, spark):
    pos = rec["position"]
    track = ax.spanned(pos, 0.1, ring=False)
    samples = movement.running_mask(pos, dt=0.0256).withColumn("bin", ax.bin_number(track, F.col("x1d")))
    laps = movement.segment_laps(pos, track, dt=0.0256)
    running = fields.select_running_samples(samples, laps).cache()
    path = [(r["t"], r["x1d"]) for r in pos.where("x1d is not null").orderBy("t").collect()]
    spikes = spark.createDataFrame([(synthetic.NAME, 102, t) for t in synthetic.place_cell_spikes(path, 1.0, np.random.default_rng(3), peak_hz=40.0)], "session string, cluster_id long, t double")
    slots = fields.spike_slots(spikes, pos, running)
    counts = fields.binned_array(slots, ["session", "cluster_id"], "bin", track.bins)
    occ = fields.binned_array(running, ["session"], "bin", track.bins, F.lit(0.0256), "occupancy")
    m = fields.rate_maps(counts, occ, ["session"], n_bins=track.bins, circular=False)
    row = m.select(fields.peak_bin(F.col("rate")).alias("b"), fields.skaggs_information(F.col("rate"), F.col("occupancy")).alias("i")).first()
    assert abs(ax.centre(track, row["b"]) - 1.0) < 0.2 and row["i"] > 0.3
    shifts = spark.createDataFrame([(k, 50 * k) for k in range(1, 6)], "shuffle_id int, shift int")
    moved = fields.shifted_spikes(slots, running, shifts, [])
    assert {r["count"] for r in moved.groupBy("shuffle_id").count().collect()} == {slots.count()}


# --- files -----------------------------------------------------------------------------------------


def test_descriptions(spark, tmp_path):
    (tmp_path / "r.a.xml").write_text(XML)
    (tmp_path / "q.xml").write_text(XML.replace("<group><channels><channel>0</channel><channel>1</channel></channels></group><group><channels><channel>3</channel><channel>2</channel></channels></group>", ""))
    recordings, channels = frames.read_descriptions(spark, f"{tmp_path}/*.xml")
    assert {(r["session"], r["n_channels"], r["rate_hz"], r["wideband_hz"], r["n_bits"], r["voltage_range"], r["amplification"]) for r in recordings.collect()} == {(s, 6.0, 1250.0, 20000.0, 16.0, 20.0, 400.0) for s in "rq"}
    assert {tuple(r) for r in channels.collect()} == {("r", 1, 0, 0, False), ("r", 1, 1, 1, True), ("r", 2, 0, 3, False), ("r", 2, 1, 2, False), ("q", 1, 0, 0, False), ("q", 1, 1, 1, True), ("q", 2, 0, 2, False), ("q", 2, 1, 3, False)}
    assert frames.problems(recordings, channels).count() == 0
    broken = {"a": XML.replace("<nChannels>6</nChannels>", ""), "b": XML.replace(">3<", ">7<"), "c": XML.replace("<nBits>16", "<nBits>12"), "d": XML.replace("1250", "-1"), "e": "<parameters></parameters>", "f": XML.replace(">2<", ">two<")}
    for name, text in broken.items():
        (tmp_path / f"broken_{name}.xml").write_text(text)
    found = {(r["session"][-1], r["problem"]) for r in frames.problems(*frames.read_descriptions(spark, f"{tmp_path}/broken_*.xml")).collect()}
    outside = "a channel that the recording does not have"
    assert found == {("a", "number of channels"), ("b", outside), ("c", "only 16 bits a sample are read"), ("d", "sampling rate"), ("e", "number of channels"), ("e", "sampling rate"), ("e", "no channel groups"), ("f", outside)}


def test_frames(spark, tmp_path):
    data = (np.arange(5000)[:, None] % 100 + 1000 * np.arange(6)[None]).astype("<i2")
    path, said = str(tmp_path / "r.eeg"), {"n_channels": 6, "rate_hz": 1250.0}
    data.tofile(path)
    assert frames.whole_frames(60_000, 6) == 5000 and frames.require_length(5000, 1250.0, 1.0) == 3.0
    with pytest.raises(frames.FormatError):
        frames.whole_frames(60_001, 6)
    with pytest.raises(frames.FormatError):
        frames.require_length(5000, 1250.0, 10.0)
    rows = frames.read_frames(spark, path, start_s=1.0, end_s=1.5, channels=[5, 0], **said).orderBy("i").collect()
    assert [r["i"] for r in rows] == list(range(1250, 1875)) and list(rows[7]["values"]) == [5000 + 1257 % 100, 1257 % 100] and rows[0]["session"] == "r"
    assert frames.read_frames(spark, path, **said).count() == 5000
    assert frames.read_windows(spark, path, [(0.0, 0.1), (2.0, 2.1)], channels=[1], **said).count() == 250
    with pytest.raises(Exception, match="channel"):
        frames.read_frames(spark, path, channels=[6], **said).count()


def test_comparisons_reach_the_reader(spark, tmp_path):
    path = str(tmp_path / "r.eeg")
    np.arange(20_000, dtype="<i2").tofile(path)
    whole = frames.read_frames(spark, path, n_channels=2, rate_hz=1.0)
    for where, want in (("i >= 10 and i < 13", [10, 11, 12]), ("i > 9998", [9999]), ("i = 7 and session = 'r'", [7]), ("i <= 1", [0, 1]), ("i = 3 and i > 5", []), ("i in (4, 6)", [4, 6]), ("values[0] = 20", [10])):
        assert [r["i"] for r in whole.where(where).orderBy("i").collect()] == want, where
    reader = frames.FrameReader({"path": path, "n_channels": "2", "frames_per_partition": "100"})
    from pyspark.sql import datasource as ds

    left = list(reader.pushFilters([ds.GreaterThan(("i",), 499), ds.LessThanOrEqual(("i",), 799), ds.EqualTo(("session",), "r")]))
    assert len(left) == 1 and [(p.first, p.last) for p in reader.partitions()] == [(500, 600), (600, 700), (700, 800)]


def packed(path, data: bytes, name: str = "d/x.eeg") -> str:
    with tarfile.open(path, "w:gz") as tar:
        for n, d in (("d/other.txt", b"other"), (name, data)):
            info = tarfile.TarInfo(n)
            info.size = len(d)
            tar.addfile(info, io.BytesIO(d))
    return str(path)


def is_eeg(name: str) -> bool:
    return name.endswith(".eeg")


def test_archive_goes_on_where_it_stopped(tmp_path):
    data = bytes(range(256)) * 4000
    path = packed(tmp_path / "a.tar.gz", data)
    assert archives.listing(path) == {"d/other.txt": 5, "d/x.eeg": len(data)}
    for start in (0, 1, 1000, len(data) - 1, len(data)):
        assert b"".join(d for _, d in archives.pieces(path, is_eeg, start, 777)) == data[start:]
    (tmp_path / "x").write_bytes(data[:1000])
    assert archives.fill(path, is_eeg, str(tmp_path / "x")) == (len(data), len(data)) and (tmp_path / "x").read_bytes() == data
    assert archives.fill(path, is_eeg, str(tmp_path / "x"))[0] == len(data)
    assert archives.fill(path, is_eeg, str(tmp_path / "y"), seconds=0.0) == (0, len(data))
    (tmp_path / "z").write_bytes(data + b"x")
    for broken in (lambda: archives.fill(path, is_eeg, str(tmp_path / "z")), lambda: list(archives.pieces(path, lambda n: False)), lambda: archives.listing(str(tmp_path / "none.tar.gz"))):
        with pytest.raises(archives.ArchiveError):
            broken()


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 0.98])
def test_truncated_archive(tmp_path, share):
    data = np.random.default_rng(0).bytes(200_000)
    path = packed(tmp_path / "a.tar.gz", data)
    whole = (tmp_path / "a.tar.gz").read_bytes()
    (tmp_path / "a.tar.gz").write_bytes(whole[: int(share * len(whole))])
    with pytest.raises(archives.ArchiveError):
        archives.fill(path, is_eeg, str(tmp_path / "x"))
    assert data.startswith((tmp_path / "x").read_bytes())  # what came is right, and a whole archive goes on from it
    (tmp_path / "a.tar.gz").write_bytes(whole)
    archives.fill(path, is_eeg, str(tmp_path / "x"))
    assert (tmp_path / "x").read_bytes() == data


def test_parameters(tmp_path):
    (tmp_path / "p.yaml").write_text("a:\n  b: 3\n")
    p = parameters.load_params(tmp_path / "p.yaml")
    assert parameters.param("a.b", p) == 3 and parameters.with_overrides(p, {"a.b": 4})["a"]["b"] == 4 and p["a"]["b"] == 3
    with pytest.raises(KeyError, match="a.c"):
        parameters.param("a.c", p)
    assert parameters.git_commit(tmp_path) == "unknown"
    with pytest.raises(FileNotFoundError):
        parameters.data_dir([tmp_path], "*.none")


def test_sidecars_merge(tmp_path):
    import json

    at = tmp_path / "fit.json"
    parameters.merged_sidecar(at, {"fit": {"a": 1, "b": [1]}, "n": 3}, "c1")
    parameters.merged_sidecar(at, {"fit": {"b": [2]}, "more": None}, "c2")
    said = json.loads(at.read_text())
    assert said.pop("written_at").startswith("20") and said == {"fit": {"a": 1, "b": [2]}, "n": 3, "more": None, "commit": "c2"} and not list(tmp_path.glob("*.new"))
