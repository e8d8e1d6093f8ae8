"""Steps whose work has to grow no faster than their tables, and results that depend on a table's size."""

from __future__ import annotations

import hashlib
import os
from functools import partial

import numpy as np
import pandas as pd
import pytest
import __spark_entry__ as entry
from oracle import connection, difference
from pyspark.sql import functions as F
from tessera.llm import media
from tessera.operators import intervals, movement, sequences, validate
from tessera.plans import checks, decoding, storage
from tessera.streaming import live


def with_events(base: str, at, rows: pd.DataFrame) -> str:
    """The tables of ``base`` with other events."""
    for name in os.listdir(base):
        if not name.startswith("events"):
            os.symlink(f"{base}/{name}", at / name)
    rows.astype({"ts": "datetime64[us]"}).to_parquet(at / "events.parquet", index=False)
    return str(at)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def differs(spark, name: str, sf_dir: str) -> str:
    return difference(entry.queries()[name](spark, sf_dir).toPandas(), connection(sf_dir).execute(entry.oracle_sql()[name]).df())


# --- the null by fixed cycles ----------------------------------------------------------------------

SHIFTS = [(k, t, (k * (2 * t + 1) + t * t) % 5) for k in range(1, 8) for t in range(12)]


@pytest.fixture(scope="module")
def cycled_events(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(30):
        t = sorted(rng.choice(12, rng.integers(1, 9), replace=False).tolist())
        p = rng.dirichlet(np.ones(5), (2, len(t)))
        rows.append((i, t, [d.ravel().tolist() for d in p]))
    return spark.createDataFrame(rows, "event_id int, tbins array<int>, posteriors array<array<double>>").repartition(3)


def test_cycles_in_the_row_are_those_of_the_long_form(spark, cycled_events):
    long = cycled_events.select("event_id", "tbins", F.posexplode("posteriors").alias("direction", "x")).select("event_id", "direction", "tbins", F.posexplode("x").alias("k", "p"))
    long = long.select("event_id", "direction", F.element_at("tbins", F.floor(F.col("k") / 5).cast("int") + 1).alias("tbin"), (F.col("k") % 5).alias("pbin"), "p")
    shifts = spark.createDataFrame(SHIFTS, "shuffle_id int, tbin int, shift int")
    null = sequences.best_direction(sequences.weighted_correlation(sequences.column_cycled(long, shifts, 5), ["event_id", "direction", "shuffle_id"], n_bins=5, circular=True), ["event_id", "shuffle_id"])
    own = sequences.best_direction(sequences.weighted_correlation(long, ["event_id", "direction"], n_bins=5, circular=True), ["event_id"]).withColumnRenamed("abs_r", "r")
    want = {r["event_id"]: r for r in sequences.null_scores(null, own, ["event_id"]).collect()}
    made = sequences.cycle_null(cycled_events, SHIFTS, events_a_time=4)
    got = {r["event_id"]: r for r in made.collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert [r[c] for c in ("abs_r", "null_mean", "null_sd")] == pytest.approx([want[i][c] for c in ("r", "null_mean", "null_sd")], abs=1e-9)
    assert not any(step in plan_of(made) for step in ("Generate", "Join"))  # no row is made or moved for a shuffle


@pytest.mark.parametrize("name", ["identity_control", "placement_means", "placement_contribution"])
def test_no_row_for_each_shuffle(spark, sf_dir, name, monkeypatch):
    def long_form(*_, **__):
        raise AssertionError("a row for each shuffle and offset")

    monkeypatch.setattr(sequences, "column_cycled", long_form)
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_templates_without_a_direction_give_no_rows(spark, cycled_events):
    none = spark.createDataFrame([], "variant string, direction int, cell int, bin int, rate double")
    assert sequences.cycle_null(cycled_events.withColumn("counts", F.col("posteriors")), SHIFTS, none).count() == 0


# --- ties of shifted maps --------------------------------------------------------------------------


def test_shifts_on_a_ring_that_is_occupied_evenly(spark, sf_dir, tmp_path):
    """Every shift of a map has the same information there, and all of them count."""
    rng = np.random.default_rng(2)
    slots = np.concatenate([np.arange(288), rng.integers(0, 288, 700)])
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(slots * 600 + rng.uniform(0, 599, len(slots)).round(3), unit="s")
    rows = pd.DataFrame({"event_id": np.arange(len(slots)), "ts": ts, "user_id": rng.integers(0, 60, len(slots)), "event_type": "view", "value": 1.0, "props": "{}"})
    assert differs(spark, "circular_shift_null", with_events(sf_dir, tmp_path, rows)) == ""


# --- sides that are cut into buckets ---------------------------------------------------------------


def test_sides_cut_into_buckets_are_not_broadcast(spark, tmp_path):
    """The files are small, the sides are not."""
    spark.range(200).select(F.lit("a").alias("session"), (F.col("id") * 10.0).alias("start"), (F.col("id") * 10.0 + 9000).alias("end")).write.parquet(str(tmp_path / "i"))
    rows = spark.read.parquet(str(tmp_path / "i"))
    met = intervals.overlapping(rows, rows, ["session"])
    assert "SortMergeJoin" in plan_of(met) and "Broadcast" not in plan_of(met)
    assert met.count() == 200 * 200


def test_whole_seconds_of_an_overlap_are_not_rounded_up(spark):
    states = spark.createDataFrame([("a", "REM", 1, 0.0, 10.9997), ("a", "NREM", 1, 0.0, 50.0)], "session string, state string, seq int, start double, end double")
    sessions = spark.createDataFrame([("a", 100.0)], "session string, sess_duration double")
    said = [r["message"] for r in validate.check_states(states, sessions, ["NREM", "REM"]).where("code = 'states_overlap'").collect()]
    assert said == ["NREM and REM: 10.999700 s"]


# --- one row for each recording --------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["linear", "circular"])
def test_samples_are_not_brought_together_by_recording(spark, tmp_path, kind):
    spark.range(2000).select(F.lit("a").alias("session"), F.col("id").alias("sample"), F.cos("id").alias("x"), F.sin("id").alias("y"), F.cos("id").alias("x1d")).write.parquet(str(tmp_path / "p"))
    out = movement.linearize_2d(spark.read.parquet(str(tmp_path / "p")), kind)
    assert "SortMergeJoin" not in plan_of(out) and "BroadcastHashJoin" in plan_of(out) and out.count() == 2000


# --- whole parts of sums ---------------------------------------------------------------------------


def test_whole_parts_of_sums_go_by_event(spark, sf_dir, tmp_path):
    """Terms whose sum is 1 in one order and just under it in another, and more of them than an int16 holds."""
    terms = [0.1, 0.2, 0.3, 0.4] * 2 + [40_000.0]
    rows = pd.DataFrame({"event_id": np.arange(9), "ts": pd.Timestamp("2024-01-01 00:01:00"), "user_id": 0, "event_type": "view", "value": terms, "props": "{}"})
    want = 0.0
    for x in terms:
        want += x
    for turn in (1, -1):  # the file's order does not matter
        at = tmp_path / str(turn)
        at.mkdir()
        frames = decoding.tens(spark, with_events(sf_dir, at, rows[::turn].reset_index(drop=True)))
        assert frames.where("i = 0").first()["values"][0] == int(want)


@pytest.mark.parametrize("name", ["pcc_contribution", "null_contributions"])
def test_means_go_by_event(spark, sf_dir, tmp_path, name):
    """0.1, 0.2 and 0.3 have a mean just above 0.2 in one order and just under it in another; a NULL counts for nothing, a day of NULLs has no mean."""
    value = [0.1, 0.2, 0.3, None, 0.2, 0.1, 0.5, None]
    day = [0, 0, 0, 0, 1, 2, 3, 4]
    rows = pd.DataFrame({"event_id": np.arange(8), "ts": pd.to_datetime("2024-01-01 00:01:00") + pd.to_timedelta(day, unit="D"), "user_id": 0, "event_type": "view", "value": value, "props": "{}"})
    made = []
    for turn in (1, -1):  # the file's order does not matter
        at = tmp_path / str(turn)
        at.mkdir()
        made.append(with_events(sf_dir, at, rows[::turn].reset_index(drop=True)))
    assert differs(spark, name, made[0]) == ""
    each = [decoding.shift_means(spark, d) for d in made]
    assert [m[1].collect() for m in each] == [[(0, (0.1 + 0.2 + 0.3) / 3)]] * 2
    assert difference(*(entry.queries()[name](spark, d).toPandas() for d in made)) == ""


# --- streams ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["stream_latch", "stream_filtered"])
def test_streams_take_equal_times_by_event(spark, sf_dir, tmp_path, name):
    """Events of one time in another order than that of their ids, users without an id or with one that no double holds, values that are NULL."""
    rng = np.random.default_rng(5)
    n = 240
    user = pd.array(rng.choice([3, 2**60 + 1, 2**60 + 2], n), dtype="Int64")
    user[rng.random(n) < 0.2] = pd.NA
    ts = pd.to_datetime("2024-01-01") + pd.to_timedelta(np.arange(n) // 6, unit="h")
    rows = pd.DataFrame({"event_id": np.arange(n), "ts": ts, "user_id": user, "event_type": "view", "value": np.where((rng.random(n) < 0.1) & (name == "stream_latch"), np.nan, rng.choice([0.0, 50.0, 100.0], n)), "props": "{}"})
    assert differs(spark, name, with_events(sf_dir, tmp_path, rows.iloc[rng.permutation(n)].reset_index(drop=True))) == ""


@pytest.mark.parametrize("name", ["stream_latch", "stream_filtered"])
def test_a_span_of_several_files_is_one_batch(spark, sf_dir, name, monkeypatch):
    several = partial(storage.event_stream, most=60)
    for module in (checks, storage):
        monkeypatch.setattr(module, "event_stream", several)
    assert differs(spark, name, sf_dir) == ""


def test_keys_share_their_state_and_their_step(spark, tmp_path):
    """A call and a state for each key cost more than its rows; 1,500 keys have 256 groups at most."""
    spark.range(3000).select((F.col("id") % 1500).alias("k"), F.timestamp_seconds("id").alias("ts"), "id", F.lit(1.0).alias("v")).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("k long, ts timestamp, id long, v double").parquet(f"{tmp_path}/in")
    for number, out in enumerate((live.latched(rows, "v", 0.5, "k"), live.halo_filtered(rows, "v", "k", "id", lambda x: x, 1))):
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out{number}").option("checkpointLocation", f"{tmp_path}/ck{number}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 256
        assert spark.read.parquet(f"{tmp_path}/out{number}").count() == (3000, 1500)[number]


# --- what is read back -----------------------------------------------------------------------------


def test_media_features_come_from_what_was_stored(spark):
    """Other stored bytes give other results, and broken ones none, whatever the text was."""
    texts = spark.createDataFrame([(1, "one text " * 50), (2, None)], "doc_id long, text string")
    stored = media.store_media(texts)
    own = {r["doc_id"]: r for r in media.media_features(stored).collect()}
    packed = {r["doc_id"]: r for r in media.media_features(media.store_media(texts, level=0)).collect()}
    assert own[1]["payload_sha256"] == packed[1]["payload_sha256"] and own[1]["media_sha256"] != packed[1]["media_sha256"] and own[1]["media_bytes"] < packed[1]["media_bytes"]
    other = media.write_png(b"another text".ljust(192))
    changed = {r["doc_id"]: r for r in media.media_features(stored.withColumn("media", F.lit(bytearray(other)))).collect()}
    assert changed[1]["payload_sha256"] == hashlib.sha256(b"another text".ljust(192)).hexdigest() != own[1]["payload_sha256"] and changed[1]["feature"] != own[1]["feature"]
    with pytest.raises(Exception, match="MediaError"):
        media.media_features(stored.withColumn("media", F.lit(bytearray(other[:-20])))).collect()
