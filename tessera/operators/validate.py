"""Checks of a recording: one row (session, severity, code, message) for each finding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlapping

#: Fixed tolerances: seconds, share of the usual sample step, the step itself, metres beyond the track.
SLACK_S, DT_SHARE, DT_S, TRACK_M = 1e-6, 0.02, 0.0256, 0.01


def _issues(df: DataFrame, findings: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """One pass: each finding is (severity, code, condition, message) over an aggregate row."""
    made = F.array(*(F.when(cond, F.struct(F.lit(sev).alias("severity"), F.lit(code).alias("code"), msg.cast("string").alias("message"))) for sev, code, cond, msg in findings))
    return df.select("session", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("_x")).select("session", "_x.*")


def check_spikes(spikes: DataFrame, sessions: DataFrame) -> DataFrame:
    """spikes: session, seq (stored order), cluster_id, t."""
    w = Window.partitionBy("session").orderBy("seq")
    rows = spikes.join(sessions.select("session", "sess_duration"), "session").withColumn("_step", F.col("t") - F.lag("t").over(w))
    bad = F.col("t").isNull() | F.isnan("t") | (F.abs("t") == float("inf"))
    late = F.col("t") > F.col("sess_duration") + SLACK_S
    agg = rows.groupBy("session").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.count_if(F.col("_step") < 0).alias("unsorted"), F.count_if(F.col("t") < -SLACK_S).alias("early"),
        F.count_if(late).alias("late"), F.countDistinct(F.when(late, F.col("cluster_id"))).alias("late_clusters"), F.count_if(F.col("cluster_id").isNull() != F.col("t").isNull()).alias("lengths"),
    )
    return _issues(agg, [
        ("error", "spike_length_mismatch", F.col("lengths") > 0, F.format_string("%d spikes lack a time or a cluster", "lengths")),
        ("error", "spike_times_nonfinite", F.col("bad") > 0, F.format_string("%d spike times are not finite", "bad")),
        ("error", "spike_times_unsorted", F.col("unsorted") > 0, F.format_string("%d steps back in time", "unsorted")),
        ("warning", "spikes_before_session_start", F.col("early") > 0, F.format_string("%d spikes before 0 s", "early")),
        ("warning", "spikes_after_session_end", F.col("late") > 0, F.format_string("%d of %d spikes after the end, in %d clusters", "late", "n", "late_clusters")),
    ])


def check_units(units: DataFrame, spikes: DataFrame) -> DataFrame:
    """units: session, cluster_id, kind (pyr or int); a cluster may be listed more than once."""
    listed = units.groupBy("session", "cluster_id").agg(F.count_if(F.col("kind") == "pyr").alias("pyr"), F.count_if(F.col("kind") == "int").alias("int"))
    seen = spikes.select("session", "cluster_id").distinct().withColumn("_seen", F.lit(1))
    both = listed.join(seen, ["session", "cluster_id"], "full").fillna(0, ["pyr", "int", "_seen"])
    agg = both.groupBy("session").agg(
        F.count_if((F.col("pyr") > 0) & (F.col("int") > 0)).alias("both"), F.count_if(F.col("pyr") > 1).alias("pyr2"), F.count_if(F.col("int") > 1).alias("int2"),
        F.count_if((F.col("pyr") > 0) & (F.col("_seen") == 0)).alias("pyr0"), F.count_if((F.col("int") > 0) & (F.col("_seen") == 0)).alias("int0"),
        F.count_if((F.col("pyr") + F.col("int") == 0) & (F.col("_seen") == 1)).alias("none"), F.count_if((F.col("_seen") == 1) & (F.col("cluster_id") % 100 < 2)).alias("noise"),
    )
    said = lambda c, what: F.format_string(f"%d clusters {what}", c)
    return _issues(agg, [
        ("error", "pyr_int_overlap", F.col("both") > 0, said("both", "are both pyr and int")),
        ("error", "pyr_ids_duplicates", F.col("pyr2") > 0, said("pyr2", "are listed as pyr twice")),
        ("error", "int_ids_duplicates", F.col("int2") > 0, said("int2", "are listed as int twice")),
        ("warning", "pyr_ids_without_spikes", F.col("pyr0") > 0, said("pyr0", "listed as pyr never fire")),
        ("warning", "int_ids_without_spikes", F.col("int0") > 0, said("int0", "listed as int never fire")),
        ("warning", "unclassified_clusters", F.col("none") > 0, said("none", "are neither pyr nor int")),
        ("warning", "noise_or_mua_cluster_present", F.col("noise") > 0, said("noise", "have a number under 2")),
    ])


def check_epochs(epochs: DataFrame, sessions: DataFrame) -> DataFrame:
    rank = F.when(F.col("epoch") == "PRE", 0).when(F.col("epoch") == "MAZE", 1).otherwise(2)
    w = Window.partitionBy("session").orderBy("_rank")
    rows = epochs.withColumn("_rank", rank).withColumn("_next", F.lead("start").over(w)).join(sessions.select("session", "sess_duration"), "session")
    named = [
        ("error", "epoch_nonpositive", F.col("end") <= F.col("start"), F.concat("epoch", F.lit(" has no length"))),
        ("error", "epoch_outside_session", (F.col("start") < -SLACK_S) | (F.col("end") > F.col("sess_duration") + SLACK_S), F.concat("epoch", F.lit(" leaves the session"))),
        ("error", "epochs_overlap", F.col("_next") < F.col("end") - SLACK_S, F.concat("epoch", F.lit(" overlaps the next"))),
        ("info", "epoch_gap", F.col("_next") > F.col("end") + SLACK_S, F.concat(F.lit("gap after "), F.col("epoch"))),
        ("warning", "post_end_not_session_end", (F.col("epoch") == "POST") & (F.abs(F.col("end") - F.col("sess_duration")) > SLACK_S), F.lit("POST does not end with the session")),
    ]
    return _issues(rows, named)


def check_position(position: DataFrame, epochs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Too few samples or an undefined 1-D position end a recording's checks there.

    sessions: session, track_length_m (NULL: unknown) and maze_kind. On a linear track the position has to lie on [0, length]; on a
    circular one, which wraps at 0, it must not be negative. A session of no kind is taken as linear.
    """
    w = Window.partitionBy("session").orderBy("sample")
    maze = epochs.where("epoch = 'MAZE'").select("session", F.col("start").alias("_lo"), F.col("end").alias("_hi"))
    rows = position.withColumn("_dt", F.col("t") - F.lag("t").over(w)).join(maze, "session", "left")
    one, xy = F.col("x1d").isNotNull(), F.col("x").isNotNull() & F.col("y").isNotNull()
    agg = rows.groupBy("session").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_dt") <= 0).alias("back"), F.count_if((F.col("t") < F.col("_lo") - SLACK_S) | (F.col("t") > F.col("_hi") + SLACK_S)).alias("outside"),
        F.percentile("_dt", 0.5).alias("dt"), F.max("_dt").alias("gap"), F.count_if(F.col("x").isNull() != F.col("y").isNull()).alias("partial"), F.count_if(~one).alias("nan"),
        F.count_if(one & ~xy).alias("odd"), F.count_if(one).alias("defined"), F.min("x1d").alias("lo"), F.max("x1d").alias("hi"),
    ).join(sessions.select("session", "track_length_m", (F.col("maze_kind") if "maze_kind" in sessions.columns else F.lit(None).cast("string")).alias("kind")), "session", "left")
    ring = F.coalesce(F.col("kind") == "circular", F.lit(False))
    beyond = (F.col("lo") < -TRACK_M) | F.coalesce(F.col("hi") > F.col("track_length_m") + TRACK_M, F.lit(False))
    long, some = F.col("n") >= 2, (F.col("n") >= 2) & (F.col("defined") > 0)
    off = F.abs(F.col("dt") - DT_S) > DT_SHARE * DT_S
    return _issues(agg, [
        ("error", "position_too_short", ~long, F.format_string("%d samples", "n")),
        ("error", "position_t_not_monotonic", long & (F.col("back") > 0), F.format_string("%d steps that do not go on", "back")),
        ("error", "position_outside_maze", long & (F.col("outside") > 0), F.format_string("%d samples outside MAZE", "outside")),
        ("info", "position_dt", long, F.format_string("step %.6f s", "dt")),
        ("warning", "position_dt_unexpected", long & off, F.format_string("step %.6f s", "dt")),
        ("warning", "position_time_gaps", long & (F.col("gap") > 1.5 * F.col("dt")), F.format_string("longest step %.6f s", "gap")),
        ("warning", "xy_partial_nan", long & (F.col("partial") > 0), F.format_string("%d samples with one of x, y", "partial")),
        ("info", "position_nan", long, F.format_string("%d samples without 1-D position", "nan")),
        ("warning", "1d_valid_where_2d_nan", long & (F.col("odd") > 0), F.format_string("%d samples", "odd")),
        ("error", "position_1d_all_nan", long & (F.col("defined") == 0), F.lit("no 1-D position")),
        ("info", "position_1d_range", some, F.format_string("%.4f to %.4f m", "lo", "hi")),
        ("warning", "position_1d_out_of_track", some & ~ring & beyond, F.format_string("from %.4f to %.4f m", "lo", "hi")),
        ("warning", "position_1d_negative", some & ring & (F.col("lo") < -TRACK_M), F.format_string("down to %.4f m", "lo")),
    ])


def check_states(states: DataFrame, sessions: DataFrame, known: list[str]) -> DataFrame:
    """states: session, state, seq (stored order), start, end. known: the state names every recording should have."""
    w = Window.partitionBy("session", "state").orderBy("seq")
    rows = states.withColumn("_prev", F.lag("start").over(w)).join(sessions.select("session", "sess_duration"), "session")
    upto = F.max("end").over(Window.partitionBy("session", "state").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_upto", upto)
    agg = rows.groupBy("session", "state").agg(
        F.count_if(F.col("end") == F.col("start")).alias("zero"), F.count_if(F.col("end") < F.col("start")).alias("neg"), F.count_if(F.col("start") < F.col("_prev")).alias("unsorted"),
        F.count_if(F.col("start") < F.col("_upto") - SLACK_S).alias("self"), F.count_if((F.col("start") < -SLACK_S) | (F.col("end") > F.col("sess_duration") + SLACK_S)).alias("outside"),
    )
    said = lambda c, what: F.format_string(f"%s: %d {what}", "state", c)
    own = _issues(agg, [
        ("warning", "state_zero_length", F.col("zero") > 0, said("zero", "of no length")),
        ("error", "state_negative_length", F.col("neg") > 0, said("neg", "end before they start")),
        ("warning", "state_unsorted", F.col("unsorted") > 0, said("unsorted", "start before the one before")),
        ("warning", "state_self_overlap", F.col("self") > 0, said("self", "overlap another")),
        ("warning", "state_outside_session", F.col("outside") > 0, said("outside", "leave the session")),
    ])
    every = sessions.select("session").withColumn("state", F.explode(F.array(*map(F.lit, known))))
    empty = every.join(states.select("session", "state").distinct(), ["session", "state"], "left_anti").select("session", F.lit("info").alias("severity"), F.lit("state_empty").alias("code"), F.concat("state", F.lit(" has no interval")).alias("message"))
    # One join for all pairs of states: each pair of intervals is met once, in the order of the state names
    known_rows = states.where(F.col("state").isin(known)).select("session", "state", "start", "end")
    length = known_rows.agg(F.percentile_approx(F.when(F.col("end") > F.col("start"), F.col("end") - F.col("start")), 0.9)).first()[0]
    met = overlapping(known_rows, known_rows, ["session"], width=max(60.0, length or 0.0)).where("state_a < state_b")
    shared = met.groupBy("session", "state_a", "state_b").agg(F.sum(F.least("end_a", "end_b") - F.greatest("start_a", "start_b")).alias("seconds")).where(F.col("seconds") > SLACK_S)
    pairs = shared.select("session", F.lit("warning").alias("severity"), F.lit("states_overlap").alias("code"), F.format_string("%s and %s: %.6f s", "state_a", "state_b", "seconds").alias("message"))
    return reduce(DataFrame.unionByName, [own, empty, pairs])


def validate(sessions: DataFrame, spikes: DataFrame, units: DataFrame, epochs: DataFrame, position: DataFrame, states: DataFrame, known_states: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [check_spikes(spikes, sessions), check_units(units, spikes), check_epochs(epochs, sessions), check_position(position, epochs, sessions), check_states(states, sessions, known_states)])


def insist(df: DataFrame, **claims: Column) -> DataFrame:
    """``df`` as it is; reading a row for which a claim is FALSE or unknown ends the job with the claim's name."""
    held = [F.when(F.coalesce(claim, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"does not hold: {name}")).cast("boolean")) for name, claim in claims.items()]
    return df.where(reduce(Column.__and__, held)) if held else df


def truncate(spikes: DataFrame, states: DataFrame, epochs: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """spikes with t <= end, states and epochs cut to the session, and a report: n_total, n_dropped, n_clusters, seconds_beyond, fraction_dropped."""
    end = sessions.select("session", F.col("sess_duration").alias("_end"))
    s = spikes.join(end, "session")
    over = F.col("t") > F.col("_end")
    report = s.groupBy("session", "_end").agg(F.count(F.lit(1)).alias("n_total"), F.count_if(over).alias("n_dropped"), F.countDistinct(F.when(over, F.col("cluster_id"))).alias("n_clusters"), F.greatest(F.max("t") - F.col("_end"), F.lit(0.0)).alias("seconds_beyond"))
    report = report.withColumn("fraction_dropped", F.coalesce(F.try_divide("n_dropped", "n_total"), F.lit(0.0))).drop("_end")
    cut = lambda df: df.join(end, "session").where(F.col("start") < F.col("_end")).withColumn("end", F.least("end", "_end")).drop("_end")
    return s.where(~over).drop("_end"), cut(states), cut(epochs), report
