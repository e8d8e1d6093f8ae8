"""Population traces, detected events, participation, comparison of event lists, as-of and overlap joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import gaussian_weights, smooth_trace
from ..operators import asof, detect, intervals
from .registry import EV, days, events, query, r6, values_sql

WEIGHTS = gaussian_weights(2.0)
R = len(WEIGHTS) // 2
KERNEL = values_sql([(k - R, w) for k, w in enumerate(WEIGHTS)], "kernel(k, w)")


def trace_sql(name: str, where: str = "TRUE") -> str:
    """A smoothed trace of events by hour, day by day: the end values of a day go on beyond it. Rounded, so that both engines meet thresholds alike."""
    return f"""{name}_n AS (SELECT g.i, g.i // 24 AS day, coalesce(n, 0) AS n FROM hours g LEFT JOIN (SELECT us // 3600000000 AS i, count(*) AS n FROM ev WHERE {where} GROUP BY 1) USING (i)),
{name} AS (SELECT a.i, a.day, round(sum(w * b.n), 6) AS v FROM {name}_n a CROSS JOIN {KERNEL} JOIN {name}_n b ON b.i = least(greatest(a.i + k, a.day * 24), a.day * 24 + 23) GROUP BY a.i, a.day)"""


def trace(ev: DataFrame, only: str = "true") -> DataFrame:
    """session, day, i, t, v of the events that ``only`` marks. The grid is one interval for each day of all events."""
    grid = days(ev).select(F.lit("s").alias("session"), F.col("day").cast("long").alias("interval_id"), (F.col("day") * 86400.0).alias("start"), ((F.col("day") + 1) * 86400.0).alias("end"))
    grid = detect.count_grid(ev.where(only).select(F.lit("s").alias("session"), "t"), grid, ["session"], 3600.0)
    out = smooth_trace(grid.withColumn("n", F.col("n").cast("double")), "n", ["session", "interval_id"], "i", 2.0, out="v")
    return out.select("session", F.col("interval_id").alias("day"), (F.col("interval_id") * 24 + F.col("i")).alias("i"), "t", r6("v", "v"))


def detect_sql(name: str, source: str, low: str = "0.3", high: str = "1.0", gap: int = 2, extra: str = "") -> str:
    """Two-threshold events of a trace: CTE ``name`` with first, last, peak (hours), v. extra: grouping columns of a parameter sweep."""
    e = f"{extra}, " if extra else ""
    cross = "CROSS JOIN sweep" if extra else ""
    return f"""{name}_b AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM {source}), {name}_f AS (SELECT {e}i, day, v, v >= round(m + {low} * s, 6) AS lo, v >= round(m + {high} * s, 6) AS hi FROM {source} CROSS JOIN {name}_b {cross}),
{name}_r AS (SELECT {e}day, min(i) AS a, max(i) AS z FROM (SELECT *, i - row_number() OVER (PARTITION BY {e}day ORDER BY i) AS island FROM {name}_f WHERE lo) GROUP BY {e}day, island HAVING bool_or(hi)),
{name}_m AS (SELECT {e}day, min(a) AS first, max(z) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY {e}day ORDER BY a) AS ev FROM (SELECT *, CASE WHEN a - lag(z) OVER (PARTITION BY {e}day ORDER BY a) < {gap} THEN 0 ELSE 1 END AS new FROM {name}_r)) GROUP BY {e}day, ev),
{name} AS (SELECT {"".join("m." + c + ", " for c in extra.split(", ") if c)}m.first, m.last, arg_max(t.i, (t.v, -t.i)) AS peak, max(t.v) AS v FROM {name}_m m JOIN {source} t ON t.i BETWEEN m.first AND m.last WHERE m.last - m.first + 1 BETWEEN 2 AND 12 GROUP BY ALL)"""


def detected(rows: DataFrame, low: float = 0.3, high: float = 1.0, gap_h: int = 2) -> DataFrame:
    """session, event_id (hour of the peak), start, peak, end, v. The baseline is one row."""
    base = detect.baseline(rows, ["session"])
    lo, hi = (F.round(F.col("mean") + k * F.col("sd"), 6) for k in (low, high))
    found = detect.two_threshold(rows.join(base, "session"), ["session", "day"], low=lo, high=hi, merge_gap=gap_h * 3600.0, min_duration=7200.0, max_duration=12 * 3600.0, dt=3600.0)
    return found.select("session", F.floor(F.col("peak") / 3600).alias("event_id"), "start", "peak", "end", F.col("peak_value").alias("v"))


@query(f"""WITH {EV}, {trace_sql("tr")} SELECT i, v FROM tr""")
def population_rate_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(events(spark, sf_dir)).select("i", "v")


@query(f"""WITH {EV}, {trace_sql("tr")}, {detect_sql("e", "tr")} SELECT first * 3600.0::DOUBLE AS start, peak * 3600.0::DOUBLE AS peak, (last + 1) * 3600.0::DOUBLE AS "end", v FROM e""")
def two_threshold_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(trace(events(spark, sf_dir))).select("start", "peak", "end", "v")


@query(f"""WITH {EV}, {trace_sql("tr")}, sweep AS (SELECT * FROM (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE)) s(high)), {detect_sql("e", "tr", high="high", extra="high")} SELECT high, count(*) AS n, sum(last - first + 1)::BIGINT AS hours FROM e GROUP BY high""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep is one more key of the detector: all thresholds in one job."""
    rows = trace(events(spark, sf_dir))
    base = detect.baseline(rows, ["session"])
    fan = rows.join(base, "session").withColumn("high", F.explode(F.array(*(F.lit(h) for h in (0.5, 1.0, 1.5, 2.0)))))
    found = detect.two_threshold(fan, ["session", "high", "day"], low=F.round(F.col("mean") + 0.3 * F.col("sd"), 6), high=F.round(F.col("mean") + F.col("high") * F.col("sd"), 6), merge_gap=7200.0, min_duration=7200.0, max_duration=12 * 3600.0, dt=3600.0)
    return found.groupBy("high").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round((F.col("end") - F.col("start")) / 3600)).cast("long").alias("hours"))


@query(f"""WITH {EV}, {trace_sql("tr")}, {detect_sql("e", "tr")} SELECT peak AS event_id, count(DISTINCT user_id) AS n_active, count(user_id) AS n_spikes FROM e LEFT JOIN ev ON us >= first * 3600000000 AND us < (last + 1) * 3600000000 GROUP BY peak""")
def event_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return detect.participation(detected(trace(ev)), ev.select(F.lit("s").alias("session"), F.col("user_id").alias("cluster_id"), "t"), ["session"], width=14400.0).drop("session")


@query(f"""WITH {EV}, {trace_sql("tr")}, {detect_sql("e", "tr")}, c AS (SELECT peak AS event_id, user_id // 10 AS shank, count(DISTINCT user_id) AS n FROM e JOIN ev ON us >= first * 3600000000 AND us < (last + 1) * 3600000000 GROUP BY ALL)
SELECT event_id, sum(n)::BIGINT AS n_active, count(*) AS n_groups, round(max(n) / sum(n), 6) AS concentration FROM c GROUP BY event_id""")
def shank_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    spikes = ev.select(F.lit("s").alias("session"), F.col("user_id").alias("cluster_id"), F.floor(F.col("user_id") / 10).alias("shank"), "t")
    by = detect.participation_by_group(detected(trace(ev)), spikes, ["session"], width=14400.0)
    return detect.concentration(by, ["session"]).select("event_id", "n_active", "n_groups", r6("concentration", "concentration"))


TWO = f"""{EV}, {trace_sql("ta")}, {trace_sql("tb", "event_type = 'error'")}, {detect_sql("a", "ta")}, {detect_sql("b", "tb")},
pairs AS (SELECT a.peak AS pa, b.peak AS pb FROM a JOIN b ON (b.first < a.last + 1 AND b.last + 1 > a.first) OR abs(b.peak - a.peak) <= 3)"""


def two_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = events(spark, sf_dir)
    return detected(trace(ev)), detected(trace(ev, "event_type = 'error'"))


@query(f"""WITH {TWO} SELECT pa AS event_id, arg_min(pb, (abs(pb - pa), pb)) AS b_event_id, arg_min(pb - pa, (abs(pb - pa), pb)) * 3600.0::DOUBLE AS offset FROM pairs GROUP BY pa""".replace("AS offset", 'AS "offset"'))
def compare_event_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_lists(spark, sf_dir)
    return detect.compare_events(a, b, ["session"], 3 * 3600.0, width=14400.0).drop("session")


@query(f"""WITH {TWO} SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, count(DISTINCT pa) AS n_a_matched, count(DISTINCT pb) AS n_b_matched, round(count(DISTINCT pa) / nullif((SELECT count(*) FROM a), 0), 6) AS fraction_a, round(count(DISTINCT pb) / nullif((SELECT count(*) FROM b), 0), 6) AS fraction_b FROM pairs""")
def event_overlap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_lists(spark, sf_dir)
    out = detect.overlap_summary(a, b, ["session"], 3 * 3600.0, width=14400.0)
    return out.select("n_a", "n_b", "n_a_matched", "n_b_matched", r6("fraction_a", "fraction_a"), r6("fraction_b", "fraction_b"))


@query(f"""WITH {TWO} SELECT a.peak AS event_id FROM a WHERE a.peak NOT IN (SELECT pa FROM pairs)""")
def unmatched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti form of the overlap-or-near join."""
    a, b = two_lists(spark, sf_dir)
    return intervals.overlapping(a, b, ["session"], near=3 * 3600.0, width=14400.0, how="left_anti").select("event_id")


@query(f"""WITH {EV}, q AS (SELECT event_id, user_id, us FROM ev WHERE event_type = 'error'), r AS (SELECT event_id AS ref_id, user_id, us FROM ev WHERE event_type = 'purchase'),
p AS (SELECT q.*, r.ref_id AS p_id, r.us AS p_us FROM q ASOF LEFT JOIN r ON q.user_id = r.user_id AND q.us >= r.us), n AS (SELECT q.event_id, r.ref_id AS n_id, r.us AS n_us FROM q ASOF LEFT JOIN r ON q.user_id = r.user_id AND q.us <= r.us),
b AS (SELECT *, CASE WHEN n_us - us < us - p_us OR p_us IS NULL THEN n_us ELSE p_us END AS b_us, CASE WHEN n_us - us < us - p_us OR p_us IS NULL THEN n_id ELSE p_id END AS b_id FROM p JOIN n USING (event_id))
SELECT event_id, user_id, CASE WHEN abs(b_us - us) <= 43200000000 THEN b_id ELSE -1 END AS ref_id FROM b""")
def nearest_asof_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error's nearest purchase of the same user, at most 12 hours away: one shuffle of both sides together."""
    ev = events(spark, sf_dir)
    q = ev.where("event_type = 'error'").select("event_id", "user_id", F.col("us").alias("t"))
    r = ev.where("event_type = 'purchase'").select(F.col("event_id").alias("ref_id"), "user_id", F.col("us").alias("t"))
    return detect.nearest_within(q, r, ["user_id"], 43_200_000_000).withColumn("ref_id", F.coalesce("ref_id", F.lit(-1).cast("long"))).select("event_id", "user_id", "ref_id")


@query(f"""WITH {EV}, q AS (SELECT event_id, user_id, us FROM ev WHERE event_type = 'error'), r AS (SELECT user_id, us, value FROM ev WHERE event_type = 'view'),
p AS (SELECT q.*, r.value AS v0, r.us AS t0 FROM q ASOF LEFT JOIN r ON q.user_id = r.user_id AND q.us >= r.us), n AS (SELECT q.event_id, r.value AS v1, r.us AS t1 FROM q ASOF LEFT JOIN r ON q.user_id = r.user_id AND q.us <= r.us)
SELECT event_id, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * ((us - t0) / (t1 - t0)) END, 5) AS value FROM p JOIN n USING (event_id)""")
def interpolated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views' values interpolated linearly at each error of the user, flat beyond both ends."""
    ev = events(spark, sf_dir)
    q = ev.where("event_type = 'error'").select("event_id", "user_id", F.col("us").alias("t"), F.lit(None).cast("double").alias("value"))
    r = ev.where("event_type = 'view'").select("user_id", F.col("us").alias("t"), "value")
    return asof.interpolated(q.drop("value"), r, ["user_id"], "value").select("event_id", F.round("value", 5).alias("value"))


@query("""WITH o AS (SELECT o_custkey AS grp, o_orderkey, min(epoch(o_orderdate))::BIGINT AS s, max(epoch(l_shipdate))::BIGINT AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL HAVING max(epoch(l_shipdate)) > min(epoch(o_orderdate))),
p AS (SELECT a.grp, least(a.e, b.e) - greatest(a.s, b.s) AS x FROM o a JOIN o b ON a.grp = b.grp AND a.o_orderkey < b.o_orderkey AND b.s < a.e AND b.e > a.s) SELECT grp, count(*) AS n_pairs, sum(x)::DOUBLE AS seconds FROM p GROUP BY grp""")
def interval_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders open at the same time, from placing to last shipment, of each customer. Lineitems are reduced before the join."""
    from ..sources.tables import table

    day = lambda c: F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    o = table(spark, sf_dir, "orders").join(last, F.col("l_orderkey") == F.col("o_orderkey"))
    o = intervals.clean_intervals(o.select(F.col("o_custkey").alias("grp"), "o_orderkey", day("o_orderdate").alias("start"), day("last").alias("end")))
    pairs = intervals.overlapping(o, o, ["grp"], width=400 * 86400.0).where("o_orderkey_a < o_orderkey_b")
    shared = F.least("end_a", "end_b") - F.greatest("start_a", "start_b")
    return pairs.groupBy("grp").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(shared).cast("double").alias("seconds"))


@query(f"""WITH {EV}, j AS (SELECT event_id, user_id, us + ((event_id * 7919 + rep * 104729) % 7200001 - 3600000) * 1000 AS us, rep FROM ev CROSS JOIN (SELECT range::INT AS rep FROM range(5)) r), o AS (SELECT us // 3600000000 AS i, count(*) AS n FROM ev GROUP BY 1),
g AS (SELECT rep, us // 3600000000 AS i, count(*) AS n FROM j WHERE us >= 0 GROUP BY ALL), x AS (SELECT o.i, o.n, quantile_cont(coalesce(g.n, 0), 0.95) AS p95, avg(coalesce(g.n, 0)) AS mean FROM o CROSS JOIN (SELECT range::INT AS rep FROM range(5)) r LEFT JOIN g ON g.rep = r.rep AND g.i = o.i GROUP BY o.i, o.n)
SELECT i, n, round(mean, 6) AS null_mean, n > p95 AS exceeds FROM x""")
def jitter_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour against five copies in which every event is displaced by up to an hour, by a hash both engines can compute."""
    ev = events(spark, sf_dir)
    reps = spark.range(5).select(F.col("id").alias("rep"))
    moved = ev.select("event_id", "us").withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    shift = ((F.col("event_id") * 7919 + F.col("rep") * 104729) % 7_200_001 - 3_600_000) * 1000
    g = moved.withColumn("us", F.col("us") + shift).where("us >= 0").groupBy("rep", F.floor(F.col("us") / 3_600_000_000).alias("i")).agg(F.count(F.lit(1)).alias("m"))
    o = ev.groupBy(F.floor(F.col("us") / 3_600_000_000).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    every = o.crossJoin(F.broadcast(reps)).join(g, ["rep", "i"], "left").withColumn("m", F.coalesce("m", F.lit(0)))  # five rows
    x = every.groupBy("i", "n").agg(F.percentile("m", 0.95).alias("p95"), F.avg("m").alias("mean"))
    return x.select("i", "n", r6("mean", "null_mean"), (F.col("n") > F.col("p95")).alias("exceeds"))
