"""Fields moved round, and spikes moved on in running time, against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from tessera.functions.kernels import smooth_numpy
from tessera.operators import fields, sequences


def loop_scores(counts, tbins, rates, cell, shift, dt, circular):
    """|r| of one event with one moved field: everything decoded again."""
    best = 0.0
    for direction in rates:
        moved = direction.copy()
        moved[cell] = np.roll(direction[cell], shift)
        x = counts @ np.log(moved) - dt * moved.sum(axis=0)
        p = np.exp(x - x.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        n = p.shape[1]
        for k in range(n if circular else 1):
            pos, w = (np.arange(n) - k) % n, p.ravel() / p.sum()
            a, t = np.tile(pos, len(tbins)).astype(float), np.repeat(tbins, n).astype(float)
            ma, mt = w @ a, w @ t
            va, vt = w @ (a - ma) ** 2, w @ (t - mt) ** 2
            if va > 1e-12 and vt > 1e-12:
                best = max(best, abs(w @ ((a - ma) * (t - mt)) / np.sqrt(va * vt)))
    return best


@pytest.fixture(scope="module")
def recording():
    rng = np.random.default_rng(4)
    rates = rng.uniform(0.2, 9, (2, 5, 7))
    events = []
    for i in range(12):
        n = rng.poisson(0.7, (rng.integers(3, 9), 5)).astype(float)
        n[:, i % 5] = 0
        events.append((i, "A" if i % 3 else "B", sorted(rng.choice(20, len(n), replace=False).tolist()), n, 0.3, 0.2 if i != 7 else 0.0))
    return rates, events


@pytest.mark.parametrize("circular", [False, True])
def test_placements_by_decoding_all_again(spark, recording, circular):
    rates, events = recording
    tuning = spark.createDataFrame([(d, c, b, float(rates[d, c, b])) for d in range(2) for c in range(5) for b in range(7)], "direction int, cell int, bin int, rate double")
    rows = [(i, e, t, n.tolist(), m, s) for i, e, t, n, m, s in events]
    df = spark.createDataFrame([*rows, (99, "A", None, None, 0.1, 0.1)], "event_id long, epoch string, tbins array<int>, counts array<array<double>>, null_mean double, null_sd double").repartition(3)
    got = {(r["epoch"], r["cell"], r["shift"]): r for r in sequences.placement_means(df, tuning, ["epoch"], dt=0.1, circular=circular).collect()}
    used = [e for e in events if len(e[2]) >= 5 and e[5] > 0]
    assert len(got) == len({e[1] for e in used}) * 5 * 7
    for (epoch, cell, shift), r in got.items():
        own = [((loop_scores(n, np.array(t), rates, cell, shift, 0.1, circular) - m) / s, n[:, cell].any()) for _, e, t, n, m, s in used if e == epoch]
        here = [z for z, present in own if present]
        assert r["mean_rz"] == pytest.approx(np.mean([z for z, _ in own])) and r["n_events"] == len(own) and r["n_present"] == len(here)
        assert r["mean_rz_present"] == (pytest.approx(np.mean(here)) if here else None)


def test_blocks_of_cells_change_nothing(recording):
    rates, events = recording
    _, _, t, n, m, s = next(e for e in events if len(e[2]) >= 5)
    whole = sequences.placed_scores(n, t, rates, 0.1, True, (m, s))
    assert np.allclose(whole, sequences.placed_scores(n, t, rates, 0.1, True, (m, s), most=1))
    assert np.isnan(sequences.placed_scores(n, t, rates, 0.1, True, (m, 0.0))).all()


def test_fresh_nulls_agree_with_the_reused_one(recording):
    """Shift 0 is the event itself, so its fresh null is that of the event; all placements have one of their own."""
    rates, events = recording
    _, _, t, n, _, _ = next(e for e in events if len(e[2]) >= 5)
    p = sequences.placed_posteriors(n, rates, slice(0, 1), 0.1)[:, 0, 0]
    null = np.abs(sequences.best_correlation(sequences.shuffled(p, "column_cycle", 4000, np.random.default_rng(1)), np.arange(7.0), np.array(t, float), True)[0]).max(axis=1)
    fresh = sequences.placed_scores(n, t, rates, 0.1, True, None, 4000, "column_cycle", (5,))
    reused = sequences.placed_scores(n, t, rates, 0.1, True, (null.mean(), null.std()))
    assert fresh[:, 0] == pytest.approx(reused[:, 0], abs=0.1) and np.isfinite(fresh).all()


def test_contribution_is_two_sided(spark):
    rng = np.random.default_rng(6)
    v = {c: rng.normal(size=9) for c in "ab"} | {"c": np.array([1.0, 2.0]), "d": np.array([np.nan, 1.0, 2.0, 3.0])}
    rows = [(c, s, None if np.isnan(x) else float(x)) for c, own in v.items() for s, x in enumerate(own)]
    got = {r["cell"]: r for r in sequences.placement_contribution(spark.createDataFrame(rows, "cell string, shift int, mean_rz double"), ["cell"]).collect()}
    for c in "ab":
        own, other = v[c][0], v[c][1:]
        d = own - other.mean()
        assert got[c]["pcc"] == pytest.approx(d) and got[c]["z"] == pytest.approx(d / other.std(ddof=1))
        assert got[c]["p"] == pytest.approx((1 + (abs(other - other.mean()) >= abs(d)).sum()) / 9) and got[c]["n_shifts"] == 8
    assert got["c"]["pcc"] is None and got["d"]["pcc"] is None


# --- shifts of running time ------------------------------------------------------------------------


@pytest.mark.parametrize("n", [2, 30, 97])
def test_counts_of_all_shifts_by_correlation(n):
    rng = np.random.default_rng(n)
    bins, per_slot = rng.integers(0, 6, n), rng.poisson(2, n)
    shifts = np.arange(n)
    want = np.stack([np.bincount(bins, np.roll(per_slot, s), 6) for s in shifts])
    slots = np.flatnonzero(per_slot)
    masks = np.fft.rfft(np.arange(6)[:, None] == bins)
    for repeat in (1, 3000):  # few spikes are looked up, many are correlated
        s, k = np.tile(slots, repeat), np.tile(per_slot[slots], repeat)
        for m in (None, masks):
            assert np.array_equal(fields.shifted_counts(s, k, bins, shifts, 6, m), repeat * want)


@pytest.mark.parametrize("circular", [False, True])
def test_null_like_the_loop(spark, circular):
    """Two sessions, smoothing, an occupancy floor that bites, cells without spikes in valid bins, one without a second slot."""
    rng = np.random.default_rng(9)
    bins = {"a": rng.choice(8, 240, p=[0.02, 0.18, 0.2, 0.2, 0.1, 0.1, 0.1, 0.1]), "b": rng.integers(0, 8, 60), "c": np.array([3])}
    spikes = {("a", c): rng.integers(0, 240, 40) for c in range(5)} | {("b", 1): rng.integers(0, 60, 30), ("a", 9): np.flatnonzero(bins["a"] == 0)[:1], ("c", 1): np.array([0, 0])}
    running = spark.createDataFrame([(s, i, int(b)) for s, own in bins.items() for i, b in enumerate(own)], "session string, slot long, bin int")
    cells = spark.createDataFrame([(s, c, int(x), 1) for (s, c), own in spikes.items() for x in own], "session string, cell int, slot long, k long")
    shifts = fields.seeded_shifts(50, seed=3, least=2)
    got = {(r["session"], r["cell"]): r for r in fields.shift_null(cells, running, ["cell"], shifts, n_bins=8, slot_s=0.5, sigma=1.0, circular=circular, min_occupancy=4.0, cells_a_task=2).collect()}
    assert set(got) == set(spikes)
    for (s, c), own in spikes.items():
        at, n = bins[s], len(bins[s])
        occ = np.bincount(at, minlength=8) * 0.5
        mode = "wrap" if circular else "constant"

        def info(slots, at=at, occ=occ, mode=mode):
            with np.errstate(all="ignore"):
                r = np.where(occ >= 4.0, smooth_numpy(np.bincount(at[slots], minlength=8).astype(float), 1.0, mode) / smooth_numpy(occ, 1.0, mode), np.nan)
            ok = ~np.isnan(r)
            if not ok.any() or not (m := (r[ok] * occ[ok]).sum() / occ[ok].sum()) > 0:
                return np.nan
            p, x = occ[ok] / occ[ok].sum(), r[ok] / m
            return round(float((p[x > 0] * x[x > 0] * np.log2(x[x > 0])).sum()), 7)

        r = got[s, c]
        null = np.array([info((own + k) % n) for k in shifts((c,), n)]) if n > 1 else np.empty(0)
        null = null[np.isfinite(null)]
        assert r["info"] == (None if np.isnan(info(own)) else pytest.approx(info(own), abs=1e-6)) and r["n_spikes"] == len(own)
        if n > 1:
            assert set(shifts((c,), n)) <= set(range(2, n - 2)) and r["n_null"] == len(null) and r["null_mean"] == pytest.approx(null.mean(), abs=1e-6)
            assert r["p"] == pytest.approx((1 + (null >= info(own)).sum()) / (1 + len(null)))
        else:
            assert r["null_mean"] is None and r["n_null"] == 0


# --- one generator dealt out -----------------------------------------------------------------------


@pytest.mark.parametrize("kind", sequences.SHUFFLES)
def test_one_stream_over_all_events_like_plain_numpy(spark, kind):
    """Events of all lengths in many partitions draw what one loop in the order of their ids draws."""
    rng = np.random.default_rng(21)
    ids = rng.permutation(60)[:25]
    events = {int(i): rng.uniform(0.1, 1, (2, int(rng.integers(2, 9)), 6)) for i in ids}
    rows = [(i, list(range(p.shape[1])), [d.ravel().tolist() for d in p]) for i, p in events.items()]
    df = spark.createDataFrame(rows, "event_id long, tbins array<int>, posteriors array<array<double>>").repartition(7)
    got = {r["event_id"]: r for r in sequences.score_events(df, circular=True, kind=kind, n_shuffles=30, seed=77, one_stream=True).collect()}
    bits = np.random.PCG64(77)
    for i in sorted(events):
        p = events[i]
        if p.shape[1] < 5:
            assert i not in got
            continue
        numbers = (bits.random_raw(30 * p.shape[1]) >> np.uint64(16)).astype(np.int64).reshape(30, -1)
        null = []
        for row in numbers:
            q = np.stack([np.stack([np.roll(d[t], -int(row[t] % 6)) for t in range(p.shape[1])]) if kind == "column_cycle" else d[np.argsort(row, kind="stable")] for d in p])
            null.append(np.abs(sequences.best_correlation(q, np.arange(6.0), np.arange(p.shape[1]) * 0.02, True)[0]).max())
        assert got[i]["null_mean"] == pytest.approx(np.mean(null)) and got[i]["null_sd"] == pytest.approx(np.std(null))


def test_places_in_the_order_of_keys(spark):
    from pyspark.sql import functions as F
    from tessera.operators.draws import placed

    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), (F.col("id") % 4).alias("n")).repartition(6)
    total = 0
    for r in sorted(placed(df, ["k"], F.col("n"), "at").collect(), key=lambda r: r["k"]):
        assert r["at"] == total
        total += r["n"]
