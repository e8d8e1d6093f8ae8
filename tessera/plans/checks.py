"""Checks of a whole recording, claims that end a job, smoothing modes, windows in chunks and on streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import gaussian_weights, smooth_array, smooth_numpy, smooth_trace_nan_aware
from ..operators import chunks, fields, islands, validate
from ..schema import shank_of
from ..sources.tables import table
from ..streaming import live
from .registry import DAY_US, EV, epoch_of, events, hours, query, r6, values_sql
from .storage import event_stream, run_stream

# --- the validator's own table ---------------------------------------------------------------------

#: Every fifty users are a session of 25 days on a track of 300 m, linear and circular by turns. Sleep is a state that no session has.
SESSION_S, TRACK, KNOWN = 25 * DAY_US / 1e6, 300.0, ["click", "error", "purchase", "signup", "sleep", "view"]


def _found(source: str, severity: str, code: str, message: str, number: str = "NULL", where: str | None = None) -> str:
    return f"SELECT session, '{severity}' AS severity, '{code}' AS code, {message} AS message, ({number})::BIGINT AS n FROM {source} WHERE {where or number + ' > 0'}"


ISSUES = f"""WITH {EV}, sp AS (SELECT 'S' || (user_id // 50) AS session, * FROM ev), sess AS (SELECT DISTINCT session FROM sp),
a AS (SELECT session, count(*) FILTER (step < 0) AS unsorted, count(*) FILTER (t < -1e-6) AS early, count(*) FILTER (t > {SESSION_S} + 1e-6) AS late FROM (SELECT *, t - lag(t) OVER (PARTITION BY session ORDER BY event_id) AS step FROM sp) GROUP BY session),
listed AS (SELECT session, cluster, sum(p) AS p, sum(i) AS i FROM (SELECT session, user_id AS cluster, 1 AS p, 0 AS i FROM sp WHERE event_type = 'signup' AND value > 150 UNION ALL SELECT session, user_id, 0, 1 FROM sp WHERE event_type = 'view' AND value > 150
 UNION ALL SELECT 'S' || (c_custkey // 50), c_custkey, 1, 0 FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY ALL),
cl AS (SELECT session, cluster, coalesce(p, 0) AS p, coalesce(i, 0) AS i, coalesce(seen, 0) AS seen FROM listed FULL JOIN (SELECT DISTINCT session, user_id AS cluster, 1 AS seen FROM sp) USING (session, cluster)),
u AS (SELECT session, count(*) FILTER (p > 0 AND i > 0) AS b, count(*) FILTER (p > 1) AS p2, count(*) FILTER (i > 1) AS i2, count(*) FILTER (p > 0 AND seen = 0) AS p0, count(*) FILTER (i > 0 AND seen = 0) AS i0, count(*) FILTER (p + i = 0) AS none_, count(*) FILTER (seen = 1 AND cluster % 100 < 2) AS noise FROM cl GROUP BY session),
e0 AS (SELECT session, least(day // 10, 2) AS k, min(t) AS s, max(t) AS e FROM sp GROUP BY ALL), ep AS (SELECT *, (['PRE', 'MAZE', 'POST'])[k + 1] AS epoch, lead(s) OVER (PARTITION BY session ORDER BY k) AS nxt FROM e0),
po AS (SELECT sp.*, t - lag(t) OVER (PARTITION BY session ORDER BY us, event_id) AS dt FROM sp),
pa AS (SELECT po.session, count(*) AS n, count(*) FILTER (dt <= 0) AS back, count(*) FILTER (t < m.s - 1e-6 OR t > m.e + 1e-6) AS outside, quantile_cont(dt, 0.5) AS mid, max(dt) AS gap, count(*) FILTER (event_type IN ('error', 'view')) AS partial, count(*) FILTER (event_type = 'click') AS nan, count(*) FILTER (event_type IN ('error', 'view')) AS odd,
 count(*) FILTER (event_type <> 'click') AS defined, min(value - 1) FILTER (event_type <> 'click') AS lo, max(value - 1) FILTER (event_type <> 'click') AS hi FROM po LEFT JOIN (SELECT session, s, e FROM ep WHERE k = 1) m ON m.session = po.session GROUP BY po.session),
iv AS (SELECT session, event_type AS state, event_id, t AS s, t + (value - 20) * 60 AS e FROM sp),
ip AS (SELECT *, lag(s) OVER (PARTITION BY session, state ORDER BY event_id) AS prev, max(e) OVER (PARTITION BY session, state ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM iv),
st AS (SELECT session, state, count(*) FILTER (e = s) AS zero, count(*) FILTER (e < s) AS neg, count(*) FILTER (s < prev) AS unsorted, count(*) FILTER (s < upto - 1e-6) AS self, count(*) FILTER (s < -1e-6 OR e > {SESSION_S} + 1e-6) AS outside FROM ip GROUP BY ALL),
ov AS (SELECT a.session, a.state AS one, b.state AS two, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS sec FROM iv a JOIN iv b ON a.session = b.session AND a.state < b.state AND a.s < b.e AND b.s < a.e AND a.e >= a.s AND b.e >= b.s GROUP BY ALL)
""" + " UNION ALL ".join([
    _found("a", "error", "spike_times_unsorted", "'# steps back in time'", "unsorted"),
    _found("a", "warning", "spikes_before_session_start", "'# spikes before # s'", "early"),
    _found("a", "warning", "spikes_after_session_end", "'# of # spikes after the end, in # clusters'", "late"),
    _found("u", "error", "pyr_int_overlap", "'# clusters are both pyr and int'", "b"),
    _found("u", "error", "pyr_ids_duplicates", "'# clusters are listed as pyr twice'", "p2"),
    _found("u", "error", "int_ids_duplicates", "'# clusters are listed as int twice'", "i2"),
    _found("u", "warning", "pyr_ids_without_spikes", "'# clusters listed as pyr never fire'", "p0"),
    _found("u", "warning", "int_ids_without_spikes", "'# clusters listed as int never fire'", "i0"),
    _found("u", "warning", "unclassified_clusters", "'# clusters are neither pyr nor int'", "none_"),
    _found("u", "warning", "noise_or_mua_cluster_present", "'# clusters have a number under #'", "noise"),
    _found("ep", "error", "epoch_nonpositive", "epoch || ' has no length'", where="e <= s"),
    _found("ep", "error", "epoch_outside_session", "epoch || ' leaves the session'", where=f"s < -1e-6 OR e > {SESSION_S} + 1e-6"),
    _found("ep", "error", "epochs_overlap", "epoch || ' overlaps the next'", where="nxt < e - 1e-6"),
    _found("ep", "info", "epoch_gap", "'gap after ' || epoch", where="nxt > e + 1e-6"),
    _found("ep", "warning", "post_end_not_session_end", "'POST does not end with the session'", where=f"k = 2 AND abs(e - {SESSION_S}) > 1e-6"),
    _found("pa", "error", "position_too_short", "'# samples'", "n", "n < 2"),
    _found("pa", "error", "position_t_not_monotonic", "'# steps that do not go on'", "back", "n >= 2 AND back > 0"),
    _found("pa", "error", "position_outside_maze", "'# samples outside MAZE'", "outside", "n >= 2 AND outside > 0"),
    _found("pa", "info", "position_dt", "'step # s'", "floor(mid)", "n >= 2"),
    _found("pa", "warning", "position_dt_unexpected", "'step # s'", "floor(mid)", "n >= 2"),
    _found("pa", "warning", "position_time_gaps", "'longest step # s'", "floor(gap)", "n >= 2 AND gap > 1.5 * mid"),
    _found("pa", "warning", "xy_partial_nan", "'# samples with one of x, y'", "partial", "n >= 2 AND partial > 0"),
    _found("pa", "info", "position_nan", "'# samples without #-D position'", "nan", "n >= 2"),
    _found("pa", "warning", "1d_valid_where_2d_nan", "'# samples'", "odd", "n >= 2 AND odd > 0"),
    _found("pa", "error", "position_1d_all_nan", "'no #-D position'", "1", "n >= 2 AND defined = 0"),
    _found("pa", "info", "position_1d_range", "CASE WHEN lo < 0 THEN '-' ELSE '' END || '# to # m'", "floor(abs(lo))", "n >= 2 AND defined > 0"),
    _found("pa", "warning", "position_1d_out_of_track", "CASE WHEN lo < 0 THEN 'from -# to # m' ELSE 'from # to # m' END", "floor(abs(lo))", f"n >= 2 AND substr(session, 2)::INT % 2 = 0 AND (lo < -0.01 OR hi > {TRACK} + 0.01)"),
    _found("pa", "warning", "position_1d_negative", "'down to -# m'", "floor(abs(lo))", "n >= 2 AND substr(session, 2)::INT % 2 = 1 AND lo < -0.01"),
    *(_found("st", severity, code, f"state || ': # {said}'", n) for severity, code, said, n in (("warning", "state_zero_length", "of no length", "zero"), ("error", "state_negative_length", "end before they start", "neg"),
      ("warning", "state_unsorted", "start before the one before", "unsorted"), ("warning", "state_self_overlap", "overlap another", "self"), ("warning", "state_outside_session", "leave the session", "outside"))),
    _found(f"(SELECT session, known FROM sess CROSS JOIN (SELECT unnest({KNOWN}) AS known) WHERE NOT EXISTS (SELECT 1 FROM iv WHERE iv.session = sess.session AND iv.state = known))", "info", "state_empty", "known || ' has no interval'", where="TRUE"),
    _found("ov", "warning", "states_overlap", "one || ' and ' || two || ': # s'", "floor(sec)", "sec > 1e-6"),
])


@query(ISSUES)
def recording_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the validator on events as a recording; numbers in a message stand as #, the first one's whole part as n."""
    ev = events(spark, sf_dir)
    name = lambda c: F.concat(F.lit("S"), shank_of(F.col(c), 50).cast("string"))
    sp = ev.withColumn("session", name("user_id"))
    sessions = sp.select("session").distinct().withColumns({"sess_duration": F.lit(SESSION_S), "track_length_m": F.lit(TRACK), "maze_kind": F.when(F.substring("session", 2, 9).cast("int") % 2 == 0, "linear").otherwise("circular")})
    spikes = sp.select("session", F.col("event_id").alias("seq"), F.col("user_id").alias("cluster_id"), "t")
    told = [sp.where((F.col("event_type") == k) & (F.col("value") > 150)).select("session", F.col("user_id").alias("cluster_id"), F.lit(kind).alias("kind")) for k, kind in (("signup", "pyr"), ("view", "int"))]
    buyers = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(name("c_custkey").alias("session"), F.col("c_custkey").alias("cluster_id"), F.lit("pyr").alias("kind"))
    units = reduce(DataFrame.unionByName, [*told, buyers])
    epochs = sp.groupBy("session", epoch_of().alias("epoch")).agg(F.min("t").alias("start"), F.max("t").alias("end"))
    but = lambda k, v: F.when(F.col("event_type") != k, v)
    sample = F.row_number().over(Window.partitionBy("session").orderBy("us", "event_id")).cast("long")
    position = sp.select("session", sample.alias("sample"), "t", but("error", F.col("value")).alias("x"), but("view", F.col("value")).alias("y"), but("click", F.col("value") - 1).alias("x1d"))
    states = sp.select("session", F.col("event_type").alias("state"), F.col("event_id").alias("seq"), F.col("t").alias("start"), (F.col("t") + (F.col("value") - 20) * 60).alias("end"))
    found = validate.validate(sessions, spikes, units, epochs, position, states, KNOWN)
    number = F.regexp_extract(F.when(~F.col("code").isin("position_1d_all_nan"), F.col("message")), r"(\d+)", 1)
    return found.select("session", "severity", "code", F.regexp_replace("message", "[0-9.]+", "#").alias("message"), F.when(number != "", number.cast("long")).alias("n"))


# --- claims ----------------------------------------------------------------------------------------


@query(f"""WITH {EV}, g AS (SELECT user_id, count(*) AS n, count(DISTINCT day) AS n_days, round(avg(value) + 1e-8, 5) AS mean FROM ev GROUP BY user_id) SELECT * FROM g""")
def insisted_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile whose shape, coverage and agreement of two computations are claimed row by row; a row that breaks a claim ends the job."""
    ev = events(spark, sf_dir)
    counts = fields.binned_array(ev, ["user_id"], "bin", 24)
    g = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("day").alias("n_days"), F.avg("value").alias("mean"), F.sum("value").alias("_sum")).join(counts, "user_id", "left")
    sound = validate.insist(g, shape=F.size("counts") == 24, coverage=fields.total(F.col("counts")) == F.col("n"), agreement=F.abs(F.col("_sum") - F.col("mean") * F.col("n")) <= 1e-9 * F.abs("_sum"))
    return sound.select("user_id", "n", "n_days", F.round(F.col("mean") + 1e-8, 5).alias("mean"))


# --- smoothing -------------------------------------------------------------------------------------

W15 = gaussian_weights(1.5)
K15 = values_sql([(k - len(W15) // 2, w) for k, w in enumerate(W15)], "kernel(k, w)")
W1 = gaussian_weights(1.0)


@query(f"""WITH {EV}, c AS (SELECT event_type, b.bin, coalesce(n, 0) AS c FROM (SELECT DISTINCT event_type FROM ev) CROSS JOIN (SELECT range::INT AS bin FROM range(24)) b LEFT JOIN (SELECT event_type, bin, count(*) AS n FROM ev GROUP BY ALL) USING (event_type, bin)),
near AS (SELECT mode, bin, k, w, CASE mode WHEN 'wrap' THEN (bin + k + 24) % 24 WHEN 'nearest' THEN greatest(0, least(23, bin + k)) ELSE bin + k END AS at FROM (SELECT unnest(['constant', 'nearest', 'wrap']) AS mode) CROSS JOIN range(24) t(bin) CROSS JOIN {K15})
SELECT event_type, mode, near.bin::INT AS bin, round(sum(w * c), 6) AS v FROM near JOIN c ON c.bin = near.at GROUP BY ALL""")
def smoothed_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile over the hours smoothed with each way to go on beyond the ends."""
    m = fields.binned_array(events(spark, sf_dir), ["event_type"], "bin", 24)
    each = [m.select("event_type", F.lit(mode).alias("mode"), F.posexplode(smooth_array(F.col("counts"), W15, mode, 24)).alias("bin", "v")) for mode in ("constant", "nearest", "wrap")]
    return reduce(DataFrame.unionByName, each).select("event_type", "mode", "bin", r6(F.col("v"), "v"))


def hourly(ev: DataFrame) -> DataFrame:
    """event_type, i (hour), n, mean value or NULL: every hour of every type."""
    each = ev.groupBy("event_type", (F.col("day").cast("long") * 24 + F.col("bin")).alias("i")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return ev.select("event_type").distinct().join(hours(ev).select("i")).join(each, ["event_type", "i"], "left").fillna(0, ["n"])


HOURLY = "h AS (SELECT event_type, hours.i, coalesce(n, 0) AS n, mean FROM (SELECT DISTINCT event_type FROM ev) CROSS JOIN hours LEFT JOIN (SELECT event_type, day::BIGINT * 24 + bin AS i, count(*) AS n, avg(value) AS mean FROM ev GROUP BY ALL) g USING (event_type, i)), ends AS (SELECT min(i) AS lo, max(i) AS hi FROM hours)"


@query(f"""WITH {EV}, {HOURLY} SELECT a.event_type, a.i, round(sum(w * b.mean) / sum(w) FILTER (b.mean IS NOT NULL), 6) AS v FROM h a CROSS JOIN ends CROSS JOIN {K15} JOIN h b ON b.event_type = a.event_type AND b.i = greatest(lo, least(hi, a.i + k)) WHERE a.mean IS NOT NULL GROUP BY ALL""")
def smoothed_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means smoothed over the hours that have one, in chunks of 100 hours."""
    h = hourly(events(spark, sf_dir)).select("event_type", "i", "mean")
    out = chunks.over_chunks(h, lambda rows, keys: smooth_trace_nan_aware(rows, "mean", keys, "i", 1.5, out="v"), ["event_type"], "i", 100, len(W15) // 2)
    return out.where("mean is not null").select("event_type", "i", r6(F.col("v"), "v"))


# --- windows in chunks -----------------------------------------------------------------------------


@query(f"""WITH {EV}, {HOURLY}, f AS (SELECT *, n > 0 AS own FROM h), g AS (SELECT *, max(CASE WHEN own THEN i END) OVER (PARTITION BY event_type ORDER BY i) AS back, min(CASE WHEN own THEN i END) OVER (PARTITION BY event_type ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM f),
b AS (SELECT event_type, i, n, own OR coalesce(ahead - back - 1 <= 2, FALSE) AS on_ FROM g), s AS (SELECT *, i - row_number() OVER (PARTITION BY event_type, on_ ORDER BY i) AS run FROM b)
SELECT event_type, i, on_ AND count(*) OVER (PARTITION BY event_type, on_, run) >= 4 AS busy FROM s""")
def chunked_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with events: gaps of two bridged, runs under four dropped, in chunks of 50 hours."""
    h = hourly(events(spark, sf_dir)).select("event_type", "i", (F.col("n") > 0).alias("busy"))

    def runs(rows: DataFrame, keys: list[str]) -> DataFrame:
        return islands.drop_short_runs(islands.bridge_short_gaps(rows, "busy", F.lit(True), keys, "i", 2), "busy", keys, "i", 4)

    return chunks.over_chunks(h, runs, ["event_type"], "i", 50, 3 + 4)


@query(f"""WITH {EV}, {HOURLY}, m AS (SELECT event_type, i, n - (SELECT avg(n) FROM h) AS x FROM h)
SELECT event_type, i, coalesce(last_value(CASE WHEN x > 2.5 THEN 1 WHEN x < -2.5 THEN -1 END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS latch FROM m""")
def chunked_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours above or under the usual count, latched; one row a chunk of 20 hours carries the state on."""
    h = hourly(events(spark, sf_dir))
    x = h.join(h.agg(F.avg("n").alias("usual"))).select("event_type", "i", (F.col("n") - F.col("usual")).alias("x"))
    return chunks.latched(x, F.col("x"), 2.5, ["event_type"], "i", 20, "latch").select("event_type", "i", "latch")


# --- a filter on a stream --------------------------------------------------------------------------

R1 = len(W1) // 2
_AROUND = " + ".join([f"{W1[R1]!r}::DOUBLE * value", *(f"{W1[R1 + k]!r}::DOUBLE * (coalesce(lag(value, {k}) OVER o, first_value(value) OVER o) + lead(value, {k}) OVER o)" for k in range(1, R1 + 1))])


@query(f"""WITH {EV} SELECT user_id, us, round(value, 6) AS value, round(v, 6) AS filtered, FALSE AS late FROM (SELECT user_id, us, value, {_AROUND} AS v FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY us, event_id)) WHERE v IS NOT NULL""")
def stream_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values smoothed as they arrive; a filter's halo goes from one micro-batch to the next."""
    rows = event_stream(spark, sf_dir).select("user_id", (F.unix_micros("ts") - 1_704_067_200_000_000).alias("us"), "event_id", "value")
    out = run_stream(spark, live.halo_filtered(rows, "value", "user_id", "us", lambda x: smooth_numpy(x, 1.0), R1, then="event_id"), "append")
    return out.select("user_id", "us", r6(F.col("value"), "value"), r6(F.col("filtered"), "filtered"), "late")
