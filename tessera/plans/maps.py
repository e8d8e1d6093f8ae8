"""Rate maps on the ring of hours, their information, fields, stability and shuffles; runs and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import gaussian_weights
from ..functions import axis as ax
from ..operators import cells, controls, fields, islands
from ..sources import tables
from .registry import EV, events, hours, query, r6, values_sql

N = 24
WEIGHTS = gaussian_weights(1.0)
KERNEL = values_sql([(k - len(WEIGHTS) // 2, w) for k, w in enumerate(WEIGHTS)], "kernel(k, w)")
HOUR_RING = ax.Axis(0.0, 24.0, 24, True)

#: Hours of occupancy by bin: ten-minute slots that hold an event of anyone, a sixth of an hour each.
OCC = "occ AS (SELECT b.bin, count(DISTINCT (us // 600000000)) / 6.0 AS o FROM (SELECT range::INT AS bin FROM range(24)) b LEFT JOIN ev USING (bin) GROUP BY b.bin)"
OCC_SMOOTH = f"occ_s AS (SELECT b.bin, sum(w * o) AS o FROM (SELECT range::INT AS bin FROM range(24)) b CROSS JOIN {KERNEL} JOIN occ ON occ.bin = (b.bin + k + 24) % 24 GROUP BY b.bin)"


def counts_sql(keys: str, source: str = "ev") -> str:
    return f"""counts AS (SELECT {keys}, b.bin, coalesce(n, 0) AS c FROM (SELECT DISTINCT {keys} FROM {source}) CROSS JOIN (SELECT range::INT AS bin FROM range(24)) b LEFT JOIN (SELECT {keys}, bin, count(*) AS n FROM {source} GROUP BY ALL) USING ({keys}, bin))"""


def map_sql(keys: str, source: str = "ev") -> str:
    """Smoothed rate by keys and bin: CTEs counts, smooth, rate."""
    return counts_sql(keys, source) + f""",
smooth AS (SELECT {keys}, b.bin, sum(w * c) AS c FROM (SELECT range::INT AS bin FROM range(24)) b CROSS JOIN {KERNEL} JOIN counts ON counts.bin = (b.bin + k + 24) % 24 GROUP BY {keys}, b.bin),
rate AS (SELECT {keys}, smooth.bin, CASE WHEN occ.o >= 0.1 THEN smooth.c / occ_s.o END AS r, occ.o FROM smooth JOIN occ USING (bin) JOIN occ_s USING (bin))"""


INFO = """sum(CASE WHEN r > 0 THEN o / t * (r / m) * log2(r / m) ELSE 0 END)"""


def occupancy(ev: DataFrame) -> DataFrame:
    slots = ev.select("bin", F.floor(F.col("us") / 600_000_000).alias("slot")).distinct()
    return fields.binned_array(slots.withColumn("_one", F.lit(1)), ["_one"], "bin", N, F.lit(1 / 6.0), "occupancy").drop("_one")


def maps(ev: DataFrame, keys: list[str], source: DataFrame | None = None) -> DataFrame:
    return fields.rate_maps(fields.binned_array(ev, keys, "bin", N), occupancy(ev if source is None else source), [], n_bins=N)


@query(f"""WITH {EV}, {OCC}, {OCC_SMOOTH}, {map_sql("user_id")}, tot AS (SELECT user_id, sum(o) AS t, sum(r * o) / sum(o) AS m FROM rate WHERE r IS NOT NULL GROUP BY user_id)
SELECT user_id, (SELECT count(*) FROM ev e WHERE e.user_id = rate.user_id) AS n_spikes, round(any_value(m), 6) AS mean_rate, round(max(r), 6) AS peak_rate, arg_max(bin, (round(r, 9), -bin)) AS peak_bin, round({INFO}, 6) AS bits_per_spike
FROM rate JOIN tot USING (user_id) WHERE r IS NOT NULL GROUP BY user_id""")
def rate_map_skaggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shuffle to (cell, bin) counts and one to cells; the rest is array arithmetic in generated code."""
    m = maps(events(spark, sf_dir), ["user_id"])
    peak = fields.peak_bin(F.transform("rate", lambda r: F.round(r, 9)))
    return m.select("user_id", fields.total(F.col("counts")).cast("long").alias("n_spikes"), r6(fields.mean_rate(F.col("rate"), F.col("occupancy")), "mean_rate"), r6(fields.peak_rate(F.col("rate")), "peak_rate"), peak.alias("peak_bin"), r6(fields.skaggs_information(F.col("rate"), F.col("occupancy")), "bits_per_spike"))


@query(f"""WITH {EV}, {OCC}, {OCC_SMOOTH}, {map_sql("user_id")}, on_ AS (SELECT user_id, bin, round(r, 9) >= round(0.7 * max(r) OVER (PARTITION BY user_id), 9) AS hi FROM rate),
n AS (SELECT user_id, bin, hi, lag(hi) OVER o AS p, lead(hi) OVER o AS q, first_value(hi) OVER w AS f, last_value(hi) OVER w AS l, bool_and(hi) OVER w AS every FROM on_ WINDOW o AS (PARTITION BY user_id ORDER BY bin), w AS (PARTITION BY user_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
s AS (SELECT user_id, bin FROM n WHERE hi AND NOT coalesce(p, l)), e AS (SELECT user_id, bin FROM n WHERE hi AND NOT coalesce(q, f)),
runs AS (SELECT s.user_id, s.bin AS first_bin, min((e.bin - s.bin + 24) % 24) + 1 AS width FROM s JOIN e USING (user_id) GROUP BY ALL UNION ALL SELECT DISTINCT user_id, 0, 24 FROM n WHERE every)
SELECT user_id, first_bin, width FROM runs WHERE width BETWEEN 2 AND 12""")
def place_fields_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = maps(events(spark, sf_dir), ["user_id"])
    # The cut is rounded as the rates are, so that both engines see the same ties.
    high = fields.let(F.transform("rate", lambda r: F.round(r, 9)), lambda x: fields.let(F.round(F.lit(0.7) * F.array_max(x), 9), lambda top: F.transform(x, lambda r: F.when(r >= top, F.lit(1.0)).otherwise(F.lit(0.0)))))
    runs = fields.find_fields(high, N, threshold_frac=0.5, min_bins=2, max_bins=12)
    return m.select("user_id", F.explode(runs).alias("x")).select("user_id", F.col("x.first").alias("first_bin"), F.col("x.n").alias("width"))


@query(f"""WITH {EV}, laps AS (SELECT *, (dense_rank() OVER (PARTITION BY user_id ORDER BY day) - 1) % 2 AS half FROM ev), {OCC}, {OCC_SMOOTH}, {map_sql("user_id, half", "laps")},
two AS (SELECT a.user_id, a.r AS x, b.r AS y FROM rate a JOIN rate b ON a.user_id = b.user_id AND a.bin = b.bin AND a.half = 0 AND b.half = 1 WHERE a.r IS NOT NULL AND b.r IS NOT NULL)
SELECT user_id, CASE WHEN count(*) >= 3 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN round(covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)), 6) END AS r FROM two GROUP BY user_id""")
def split_half_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    m = maps(fields.split_halves(ev, ["user_id"], "day"), ["user_id", "half"], ev)
    by = m.groupBy("user_id").agg(F.max(F.when(F.col("half") == 0, F.col("rate"))).alias("a"), F.max(F.when(F.col("half") == 1, F.col("rate"))).alias("b")).where("a is not null and b is not null")
    return by.select("user_id", r6(fields.pearson(F.col("a"), F.col("b")), "r"))


@query(f"WITH {EV} SELECT user_id, count(DISTINCT day) AS n_laps FROM ev WHERE event_type IN ('view', 'click') GROUP BY user_id")
def laps_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.laps_active(events(spark, sf_dir).where("event_type in ('view', 'click')"), ["user_id"], "day")


@query(f"""WITH {EV}, {OCC}, {OCC_SMOOTH}, {counts_sql("user_id").replace("counts AS", "counts0 AS", 1)},
counts AS (SELECT user_id, s.shift, (bin + s.shift) % 24 AS bin, c FROM counts0 CROSS JOIN (SELECT range::INT AS shift FROM range(24)) s),
smooth AS (SELECT user_id, shift, b.bin, sum(w * c) AS c FROM (SELECT range::INT AS bin FROM range(24)) b CROSS JOIN {KERNEL} JOIN counts ON counts.bin = (b.bin + k + 24) % 24 GROUP BY ALL),
rate AS (SELECT user_id, shift, smooth.bin, CASE WHEN occ.o >= 0.1 THEN smooth.c / occ_s.o END AS r, occ.o FROM smooth JOIN occ USING (bin) JOIN occ_s USING (bin)),
tot AS (SELECT user_id, shift, sum(o) AS t, sum(r * o) / sum(o) AS m FROM rate WHERE r IS NOT NULL GROUP BY ALL),
info AS (SELECT user_id, shift, round({INFO}, 7) AS i FROM rate JOIN tot USING (user_id, shift) WHERE r IS NOT NULL GROUP BY ALL)
SELECT a.user_id, round(a.i, 6) AS observed, count(*) FILTER (b.i >= a.i) AS n_at_least, round((1 + count(*) FILTER (b.i >= a.i)) / 24.0, 6) AS p FROM info a JOIN info b ON a.user_id = b.user_id AND a.shift = 0 AND b.shift > 0 GROUP BY a.user_id, a.i""")
def circular_shift_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 23 shifts of each cell as array rolls: the fan-out never leaves the cell's row."""
    m = maps(events(spark, sf_dir), ["user_id"])
    from ..functions.kernels import smooth_array

    occ = smooth_array(F.col("occupancy"), WEIGHTS, "wrap", N)

    fan = m.withColumn("_o", occ).withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(N - 1))))
    moved = smooth_array(fields.rolled(F.col("counts"), F.col("shift"), N), WEIGHTS, "wrap", N)
    fan = fan.withColumn("_c", moved)
    rate = F.transform(F.arrays_zip("_c", "_o", "occupancy"), lambda x: F.when(x["occupancy"] >= 0.1, F.try_divide(x["_c"], x["_o"])))
    fan = fan.withColumn("_r", rate).withColumn("i", F.round(fields.skaggs_information(F.col("_r"), F.col("occupancy")), 7))
    own = fan.groupBy("user_id").agg(F.max(F.when(F.col("shift") == 0, F.col("i"))).alias("_own"), F.collect_list(F.when(F.col("shift") > 0, F.col("i"))).alias("nulls"))
    # The nulls are held against the value before it is rounded for the result: in a lambda a name means the result's column of that name, if there is one.
    n = F.size(F.filter("nulls", lambda x: x >= F.col("_own")))
    return own.select("user_id", r6("_own", "observed"), n.cast("long").alias("n_at_least"), r6(fields.empirical_p(n, 23), "p"))


# --- runs, latches, trajectories ------------------------------------------------------------------

HOURLY = """h AS (SELECT g.i, coalesce(n, 0) AS n, coalesce(n, 0) >= c.m AS busy FROM hours g LEFT JOIN (SELECT us // 3600000000 AS i, count(*) AS n FROM ev GROUP BY 1) USING (i) CROSS JOIN (SELECT count(*) / (SELECT 24.0 * count(*) FROM days) AS m FROM ev) c)"""


def hourly(ev: DataFrame) -> DataFrame:
    """i, n, busy: events by hour of all days with empty hours, and whether there are as many as on average."""
    n = ev.groupBy(F.floor(F.col("us") / 3_600_000_000).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    mean = ev.agg((F.count(F.lit(1)) / (24.0 * (F.max("day") - F.min("day") + 1))).alias("m"))
    return hours(ev).select("i").join(n, "i", "left").crossJoin(F.broadcast(mean)).select(F.lit("s").alias("session"), "i", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= F.col("m")).alias("busy"))


@query(f"""WITH {EV}, {HOURLY}, g AS (SELECT i, i - row_number() OVER (ORDER BY i) AS island FROM h WHERE busy) SELECT min(i) * 3600.0::DOUBLE AS start, (max(i) + 1) * 3600.0::DOUBLE AS "end", count(*) AS n FROM g GROUP BY island""")
def mask_to_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hourly(events(spark, sf_dir)).withColumn("t", F.col("i") * 3600.0)
    return islands.mask_to_intervals(rows, F.col("busy"), ["session"], dt=3600.0, chunk=100).select("start", "end", "n")


@query(f"""WITH {EV}, {HOURLY}, a AS (SELECT *, max(CASE WHEN busy THEN i END) OVER (ORDER BY i) AS b0, min(CASE WHEN busy THEN i END) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b1 FROM h),
f AS (SELECT *, busy OR (b0 IS NOT NULL AND b1 IS NOT NULL AND b1 - b0 - 1 <= 2 AND min(CASE WHEN NOT busy THEN (n > 0)::INT END) OVER (PARTITION BY b0) = 1) AS on_ FROM a),
g AS (SELECT *, row_number() OVER (ORDER BY i) - row_number() OVER (PARTITION BY on_ ORDER BY i) AS island FROM f), k AS (SELECT i, busy, on_ AND count(*) OVER (PARTITION BY on_, island) >= 3 AS kept FROM g) SELECT i, busy, kept FROM k""")
def bridge_and_drop_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hourly(events(spark, sf_dir)).withColumn("kept", F.col("busy"))
    rows = islands.bridge_short_gaps(rows, "kept", F.col("n") > 0, ["session"], "i", 2)
    return islands.drop_short_runs(rows, "kept", ["session"], "i", 3).select("i", "busy", "kept")


@query(f"""WITH {EV}, v AS (SELECT user_id, event_id, us, value - 50 AS x FROM ev), m AS (SELECT *, CASE WHEN x > 25 THEN 1 WHEN x < -25 THEN -1 END AS mark FROM v),
l AS (SELECT user_id, event_id, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), 0) AS latch FROM m) SELECT user_id, event_id, latch FROM l""")
def hysteresis_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).withColumn("at", F.struct("us", "event_id"))
    return ev.select("user_id", "event_id", islands.hysteresis(F.col("value") - 50, 25.0, ["user_id"], "at").alias("latch"))


@query(f"""WITH {EV}, v AS (SELECT user_id, event_id, us, value - 50 AS x FROM ev), l AS (SELECT *, coalesce(last_value(CASE WHEN x > 25 THEN 1 WHEN x < -25 THEN -1 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), 0) AS d FROM v),
c AS (SELECT *, CASE WHEN lag(d) OVER o = d THEN 0 ELSE 1 END AS new FROM l WINDOW o AS (PARTITION BY user_id ORDER BY us, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM c)
SELECT user_id, d AS direction, min(event_id) AS first_event, count(*) AS n, max(us) - min(us) AS duration_us FROM s WHERE d <> 0 GROUP BY user_id, seg, d HAVING count(*) >= 2""")
def lap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).withColumn("at", F.struct("us", "event_id"))
    w = Window.partitionBy("user_id").orderBy("at")
    rows = ev.withColumn("direction", islands.hysteresis(F.col("value") - 50, 25.0, ["user_id"], "at"))
    new = F.coalesce(F.lag("direction").over(w) != F.col("direction"), F.lit(True)).cast("int")
    rows = rows.withColumn("_new", new).withColumn("_seg", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    laps = rows.where("direction <> 0").groupBy("user_id", "_seg", "direction").agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("n"), (F.max("us") - F.min("us")).alias("duration_us"))
    return laps.where("n >= 2").drop("_seg")


@query(f"""WITH {EV}, d AS (SELECT event_id, user_id, value AS x, us / 3.6e9 AS h, row_number() OVER o AS k, lag(value) OVER o AS x0, lead(value) OVER o AS x1, lag(us) OVER o / 3.6e9 AS h0, lead(us) OVER o / 3.6e9 AS h1 FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT event_id, user_id, round(CASE WHEN h0 IS NULL THEN (x1 - x) / (h1 - h) WHEN h1 IS NULL THEN (x - x0) / (h - h0) ELSE ((h - h0) ** 2 * (x1 - x) + (h1 - h) ** 2 * (x - x0)) / ((h - h0) * (h1 - h) * (h1 - h0)) END, 4) AS speed FROM d""")
def speed_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).withColumn("at", F.struct("us", "event_id")).withColumn("h", F.col("us") / 3.6e9)
    return ev.select("event_id", "user_id", F.round(islands.gradient(F.col("value"), F.col("h"), ["user_id"], "at"), 4).alias("speed"))


RING = "((x + 12) - floor((x + 12) / 24) * 24 - 12)"


@query(f"""WITH {EV}, s AS (SELECT user_id, event_id, us, bin + 0.5 AS h, (bin + 0.5) - lag(bin + 0.5) OVER o AS x FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT user_id, event_id, round(sum(coalesce({RING}, h)) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), 6)::DOUBLE AS unwrapped FROM s""")
def unwrap_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).withColumn("at", F.struct("us", "event_id")).withColumn("h", F.col("bin") + 0.5)
    return ax.unrolled(HOUR_RING, ev, "h", ["user_id"], "at", "unwrapped").select("user_id", "event_id", r6(F.col("unwrapped").cast("double"), "unwrapped"))


@query(f"""WITH {EV}, s AS (SELECT event_id, (us % 86400000000) / 3.6e9 AS h, (us % 86400000000) / 3.6e9 - value / 4 AS x, value / 4 AS v FROM ev)
SELECT event_id, round({RING}, 6) AS difference, round(abs({RING}), 6) AS distance, (floor(h - v) - floor(floor(h - v) / 24) * 24)::INT AS bin FROM s""")
def ring_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, v = (F.col("us") % 86_400_000_000) / 3.6e9, F.col("value") / 4
    return events(spark, sf_dir).select("event_id", r6(ax.way(HOUR_RING, h, v), "difference"), r6(F.abs(ax.way(HOUR_RING, h, v)), "distance"), ax.bin_number(HOUR_RING, h - v).alias("bin"))



# --- the table of place fields ---------------------------------------------------------------------

SHUFFLES, LEAST_H = 200, 4.9
CRITERIA = {"min_spikes": 20, "min_peak_hz": 0.05, "alpha": 0.6, "min_stability": -0.5}
_NEAR = [(a, (a + k - len(WEIGHTS) // 2) % 24, w) for a in range(24) for k, w in enumerate(WEIGHTS)]

#: Ten-minute slots with a purchase are the running ones, days are laps, forty groups of users are cells; whole maps (h -1) and those of every other day.
PLACE = f"""{EV}, run AS (SELECT *, row_number() OVER (ORDER BY slot10) - 1 AS slot FROM (SELECT DISTINCT us // 600000000 AS slot10, day, bin FROM ev WHERE event_type = 'purchase')), size AS (SELECT count(*) AS n, count(DISTINCT day) AS laps FROM run),
lap AS (SELECT day, (row_number() OVER (ORDER BY day) - 1) % 2 AS half FROM (SELECT DISTINCT day FROM run)), rn AS (SELECT slot, bin, -1::BIGINT AS h FROM run UNION ALL SELECT slot, bin, half FROM run JOIN lap USING (day)),
grid AS (SELECT range // 24 - 1 AS h, (range % 24)::INT AS bin FROM range(72)), kern AS (SELECT * FROM {values_sql(_NEAR, "t(a, b, w)")}),
raw AS (SELECT grid.h, grid.bin, count(slot) / 6.0 AS o FROM grid LEFT JOIN rn ON rn.h = grid.h AND rn.bin = grid.bin GROUP BY ALL), occ AS (SELECT raw.h, b AS bin, any_value(own.o) AS o, sum(raw.o * w) AS so FROM raw JOIN kern ON raw.bin = a JOIN raw own ON own.h = raw.h AND own.bin = b GROUP BY raw.h, b),
c AS (SELECT user_id % 40 AS cell, slot, count(*) AS k FROM ev JOIN run ON run.slot10 = us // 600000000 GROUP BY ALL), cells AS (SELECT cell, sum(k) AS n_spikes FROM c GROUP BY cell),
sh AS (SELECT cell, k AS s, CASE WHEN k = 0 THEN 0 ELSE 1 + ('0x' || substr(md5('0:' || cell || ':' || k), 1, 12))::BIGINT % (n - 2) END AS shift, n AS slots FROM range({SHUFFLES + 1}) t(k), size, cells),
mv AS MATERIALIZED (SELECT cell * 1000 + s AS cs, (c.slot + shift) % slots AS slot, k FROM c JOIN sh USING (cell)), mk AS (SELECT cs * 72 + run.bin AS k, mv.k AS n FROM mv JOIN run USING (slot) UNION ALL SELECT ((cell * 1000) * 3 + half + 1) * 24 + bin, c.k FROM c JOIN run USING (slot) JOIN lap USING (day)),
m AS (SELECT k, sum(n) AS n FROM mk GROUP BY k), sk AS (SELECT k - k % 24 + b AS k, n * w AS n FROM m JOIN kern ON k % 24 = a), sm AS (SELECT k // 72000 AS cell, k // 72 % 1000 AS s, k // 24 % 3 - 1 AS h, (k % 24)::INT AS bin, n FROM (SELECT k, sum(n) AS n FROM sk GROUP BY k)),
valid AS (SELECT h, bin, o, so, o / sum(o) OVER (PARTITION BY h) AS q FROM occ WHERE o >= {LEAST_H}),
r AS (SELECT sh.cell, sh.s, v.h, v.bin, v.q, coalesce(sm.n, 0) / so AS r FROM sh JOIN valid v ON sh.s = 0 OR v.h = -1 LEFT JOIN sm ON sm.cell = sh.cell AND sm.s = sh.s AND sm.h = v.h AND sm.bin = v.bin),
i AS (SELECT cell, s, round(sum(CASE WHEN r > 0 THEN q * r / m * log2(r / m) ELSE 0 END), 7) AS info, any_value(m) AS m FROM (SELECT *, sum(q * r) OVER (PARTITION BY cell, s) AS m FROM r WHERE h = -1) WHERE m > 0 GROUP BY cell, s),
nul AS (SELECT a.cell, any_value(a.info) AS info, any_value(a.m) AS m, avg(b.info) AS null_mean, (any_value(a.info) - avg(b.info)) / stddev_pop(b.info) AS z, (1 + count(*) FILTER (b.info >= a.info)) / (1.0 + count(*)) AS p FROM i a JOIN i b ON a.cell = b.cell AND a.s = 0 AND b.s > 0 GROUP BY a.cell),
peak AS (SELECT cell, max(r) AS peak, arg_max(bin, (round(r, 9), -bin)) AS place FROM r WHERE s = 0 AND h = -1 GROUP BY cell), hi AS (SELECT peak.cell, b.b AS bin, r.r, coalesce(r.r >= 0.7 * peak AND peak > 0, FALSE) AS on_ FROM peak CROSS JOIN (SELECT range::INT AS b FROM range(24)) b LEFT JOIN (SELECT * FROM r WHERE s = 0 AND h = -1) r ON r.cell = peak.cell AND r.bin = b.b),
e AS (SELECT a.cell, a.bin, a.on_ AND NOT p.on_ AS opens, a.on_ AND NOT n.on_ AS shuts, bool_and(a.on_) OVER (PARTITION BY a.cell) AS every FROM hi a JOIN hi p ON p.cell = a.cell AND p.bin = (a.bin + 23) % 24 JOIN hi n ON n.cell = a.cell AND n.bin = (a.bin + 1) % 24),
f AS (SELECT s.cell, s.bin AS first, min((t.bin - s.bin + 24) % 24) + 1 AS n FROM e s JOIN e t ON t.cell = s.cell AND t.shuts WHERE s.opens GROUP BY ALL HAVING min((t.bin - s.bin + 24) % 24) + 1 BETWEEN 2 AND 12),
fs AS (SELECT cell, count(*)::INT AS n_fields, sum(n)::INT AS width, max(n)::INT AS largest FROM f GROUP BY cell), io AS (SELECT hi.cell, avg(r) FILTER (f.cell IS NOT NULL) AS in_, avg(r) FILTER (f.cell IS NULL) AS out_ FROM hi LEFT JOIN f ON f.cell = hi.cell AND (hi.bin - first + 24) % 24 < n WHERE r IS NOT NULL GROUP BY hi.cell),
st AS (SELECT cell, CASE WHEN count(*) >= 3 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) END AS stability FROM (SELECT a.cell, a.r AS x, b.r AS y FROM r a JOIN r b ON a.cell = b.cell AND a.bin = b.bin AND a.s = 0 AND b.s = 0 AND a.h = 0 AND b.h = 1) GROUP BY cell),
act AS (SELECT cell, count(DISTINCT day) AS n_laps_active FROM c JOIN run USING (slot) GROUP BY cell),
tab AS (SELECT cell, n_spikes, m, peak, place, info, null_mean, z, p, coalesce(n_fields, 0) AS n_fields, coalesce(width, 0) AS width, largest, in_, out_, stability, n_laps_active, laps,
 coalesce(n_spikes >= 20 AND peak >= 0.05 AND p < 0.6 AND coalesce(n_fields, 0) >= 1, FALSE) AS core FROM cells LEFT JOIN peak USING (cell) LEFT JOIN nul USING (cell) LEFT JOIN fs USING (cell) LEFT JOIN io USING (cell) LEFT JOIN st USING (cell) JOIN act USING (cell) CROSS JOIN size)"""


def place_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).withColumn("slot10", F.floor(F.col("us") / 600_000_000))
    # One row a slot: a window over the recording's length, not its events
    running = ev.where("event_type = 'purchase'").select("slot10", "day", "bin").distinct().withColumn("slot", F.row_number().over(Window.orderBy("slot10")) - 1).withColumn("session", F.lit("s"))
    spikes = ev.join(running.select("session", "slot10", "slot"), "slot10").groupBy("session", (F.col("user_id") % 40).alias("cluster_id"), "slot").agg(F.count(F.lit(1)).alias("k"))
    return cells.place_field_table(spikes, running.select("session", "slot", "bin", F.col("day").alias("lap")), fields.seeded_shifts(SHUFFLES), n_bins=24, slot_s=1 / 6.0, min_occupancy=LEAST_H, threshold_frac=0.7, min_width=2, max_width_frac=0.5, **CRITERIA)


@query(f"""WITH {PLACE} SELECT cell AS cluster_id, n_spikes::BIGINT AS n_spikes, round(m, 6) AS mean_rate, round(peak, 6) AS peak_rate, place AS peak_bin, round(info, 5) AS info, round(info * m, 5) AS info_per_second, round(null_mean, 5) AS null_mean, round(z, 3) AS info_z, round(p, 6) AS p, n_fields, width::DOUBLE AS field_width, largest::DOUBLE AS largest_field_width,
round(in_, 6) AS in_field_rate, round(out_, 6) AS out_field_rate, round(stability, 5) AS stability, n_laps_active, laps AS n_laps, core AND coalesce(stability >= -0.5, FALSE) AS is_place_cell, core AS passes_core FROM tab""")
def place_field_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps, information against 200 shifts, fields, stability and the verdict of every cell."""
    t = place_fields(spark, sf_dir)
    return t.select(
        "cluster_id", "n_spikes", r6("mean_rate", "mean_rate"), r6("peak_rate", "peak_rate"), "peak_bin", F.round("info", 5).alias("info"), F.round("info_per_second", 5).alias("info_per_second"), F.round("null_mean", 5).alias("null_mean"), F.round("info_z", 3).alias("info_z"), r6("p", "p"), "n_fields", "field_width",
        "largest_field_width", r6("in_field_rate", "in_field_rate"), r6("out_field_rate", "out_field_rate"), F.round("stability", 5).alias("stability"), "n_laps_active", "n_laps", "is_place_cell", "passes_core",
    )


@query(f"""WITH {PLACE}, v(variant, spikes, alpha, stab) AS (VALUES ('base', 20, 0.6, -0.5), ('stable', 20, 0.6, 0.1), ('sure', 20, 0.2, -0.5), ('busy', 90, 0.6, -0.5))
SELECT variant, count(cell) AS n_cells, count(cell) AS n_pairs FROM v LEFT JOIN tab ON n_spikes >= spikes AND peak >= 0.05 AND p < alpha AND n_fields >= 1 AND stability >= stab GROUP BY variant""")
def place_cell_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many place cells each set of criteria leaves of the same table."""
    variants = {"base": {}, "stable": {"min_stability": 0.1}, "sure": {"alpha": 0.2}, "busy": {"min_spikes": 90}}
    made = tables.written(place_fields(spark, sf_dir), "place-fields")
    return controls.criteria_sweep(made, {name: CRITERIA | own for name, own in variants.items()}, [])
