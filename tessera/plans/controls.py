"""Controls, choices and report tables on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import controls, detect, reports
from .detection import detect_sql, detected, trace, trace_sql
from .maps import OCC, OCC_SMOOTH, map_sql, maps
from .registry import EPOCH, EV, days, epoch_of, events, query, r6


@query(f"""WITH {EV}, d AS (SELECT user_id // 50 AS grp, {EPOCH} AS epoch, floor(value)::DOUBLE AS x FROM ev WHERE day < 10 OR day >= 20), rk AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY x) + (count(*) OVER (PARTITION BY grp, x) - 1) / 2.0 AS r FROM d),
t AS (SELECT grp, sum(n * n * n - n) AS ties FROM (SELECT grp, x, count(*)::DOUBLE AS n FROM d GROUP BY ALL) GROUP BY grp),
u AS (SELECT grp, count(*) FILTER (epoch = 'PRE') AS n_first, count(*) FILTER (epoch = 'POST') AS n_second, quantile_cont(x, 0.5) FILTER (epoch = 'PRE') AS m1, quantile_cont(x, 0.5) FILTER (epoch = 'POST') AS m2, sum(r) FILTER (epoch = 'POST') AS r FROM rk GROUP BY grp),
v AS (SELECT *, r - n_second * (n_second + 1) / 2.0 AS u FROM u JOIN t USING (grp))
SELECT grp, n_first, n_second, m1 AS median_first, m2 AS median_second, m2 - m1 AS difference, round(2 * u / (n_first * n_second) - 1, 6) AS rank_biserial,
round(greatest(abs(u - n_first * n_second / 2.0) - 0.5, 0) / sqrt(n_first * n_second / 12.0 * (n_first + n_second + 1 - ties / ((n_first + n_second) * (n_first + n_second - 1.0)))), 6) AS z FROM v""")
def epoch_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir).where("day < 10 or day >= 20").select(F.floor(F.col("user_id") / 50).alias("grp"), epoch_of().alias("epoch"), F.floor("value").cast("double").alias("x"))
    return controls.compare_epochs(d, ["grp"], "x").withColumn("rank_biserial", r6("rank_biserial")).withColumn("z", r6("z"))


@query(f"""WITH {EV}, d AS (SELECT user_id // 50 AS grp, {EPOCH} AS epoch, event_id, value FROM ev WHERE day < 10 OR day >= 24), s AS (SELECT grp, count(*) AS n, quantile_cont(value, 0.5) AS m FROM d WHERE epoch = 'POST' GROUP BY grp),
r AS (SELECT grp, draw, value, row_number() OVER (PARTITION BY grp, draw ORDER BY md5('3:' || draw || ':' || event_id), event_id) AS k FROM d CROSS JOIN range(20) t(draw) WHERE epoch = 'PRE'),
e AS (SELECT grp, draw, m - quantile_cont(value, 0.5) AS x FROM r JOIN s USING (grp) WHERE k <= n GROUP BY grp, draw, m) SELECT grp, round(quantile_cont(x, 0.05), 6) AS p5, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95 FROM e GROUP BY grp""")
def subsampled_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier epoch drawn at the later one's size, 20 seeded draws."""
    d = events(spark, sf_dir).where("day < 10 or day >= 24").select(F.floor(F.col("user_id") / 50).alias("grp"), epoch_of().alias("epoch"), "event_id", "value")
    out = controls.subsampled_differences(d, ["grp"], "event_id", "value", 20, 3)
    return out.select("grp", *(r6(c, c) for c in ("p5", "p50", "p95")))


@query(f"""WITH {EV}, n AS (SELECT event_type, least(floor(value / 10), 9)::INT AS bin, count(*) AS n FROM ev WHERE value BETWEEN 0 AND 100 GROUP BY ALL)
SELECT event_type, b.bin, b.bin * 10.0::DOUBLE AS "left", (b.bin + 1) * 10.0::DOUBLE AS "right", coalesce(n, 0) AS n FROM (SELECT DISTINCT event_type FROM ev) CROSS JOIN (SELECT range::INT AS bin FROM range(10)) b LEFT JOIN n USING (event_type, bin)""")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(events(spark, sf_dir), ["event_type"], "value", 0.0, 100.0, 10)


@query(f"WITH {EV} SELECT event_type, (us // 21600000000) * 21600.0::DOUBLE AS start, round(count(*) * 60 / 21600.0, 6) AS per_minute FROM ev GROUP BY event_type, us // 21600000000")
def event_rate_over_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rate_over_session(events(spark, sf_dir), ["event_type"], 21600.0, "t").withColumn("per_minute", r6("per_minute"))


@query(f"""WITH {EV}, n AS (SELECT event_type, floor(value) AS level, count(*) AS n FROM ev GROUP BY ALL) SELECT event_type, level::DOUBLE AS level, n, round(sum(n) OVER (PARTITION BY event_type ORDER BY level) / sum(n) OVER (PARTITION BY event_type), 6) AS share FROM n""")
def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_type", F.floor("value").cast("double").alias("level"))
    return reports.distribution(rows, ["event_type"], "level").withColumn("share", r6("share"))


@query(f"""WITH {EV}, {OCC}, {OCC_SMOOTH}, {map_sql("user_id")}, p AS (SELECT user_id, max(round(r, 9)) AS top, arg_max(bin, (round(r, 9), -bin)) AS peak FROM rate GROUP BY user_id HAVING max(r) > 0), o AS (SELECT *, row_number() OVER (ORDER BY peak, user_id) - 1 AS position FROM p)
SELECT user_id, position::INT AS position, bin, round(r / top, 5) AS v FROM rate JOIN o USING (user_id)""")
def rate_map_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = maps(events(spark, sf_dir), ["user_id"]).select("user_id", F.transform("rate", lambda r: F.round(r, 9)).alias("rate"))
    return reports.heatmap(m, ["user_id"]).withColumn("v", F.round("v", 5))


@query(f"""WITH {EV}, r AS (SELECT DISTINCT user_id % 6 AS grp, day FROM ev), k AS (SELECT grp, day, dense_rank() OVER (PARTITION BY grp ORDER BY day) - 1 AS r, count(*) OVER (PARTITION BY grp) AS n FROM r)
SELECT grp, day, (SELECT max(f) FROM range(4) t(f) WHERE n * f // 4 <= r)::INT AS fold FROM k""")
def contiguous_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select((F.col("user_id") % 6).alias("grp"), "day").distinct()
    return controls.folded(rows, ["grp"], "day", 4)


@query(f"""WITH {EV}, l AS (SELECT d AS lap, d * 86400.0 AS a, d * 86400.0 + (5 + d % 4) * 5000.0 AS b FROM days t(d)), k AS (SELECT range AS k FROM range(10))
SELECT lap::INT AS lap, k::INT AS k, (a + k * 7200.0)::DOUBLE AS start, (a + (k + 1) * 7200.0)::DOUBLE AS "end" FROM l JOIN k ON k < floor((b - a) / 7200.0)""")
def running_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("day")
    laps = days(events(spark, sf_dir)).select(F.lit("s").alias("session"), day.alias("lap"), (day * 86400.0).alias("t_start"), (day * 86400.0 + (5 + day % 4) * 5000.0).alias("t_end"))
    return controls.running_windows(laps, 7200.0).drop("session")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as cells, with criteria that depend on their number."""
    u = F.col("user_id")
    n = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_spikes"), (F.max("value") / 50).alias("peak_rate"))
    return n.select(u.alias("cluster_id"), (u % 2).alias("direction"), "n_spikes", "peak_rate", ((u % 20) / 200).alias("p"), (u % 3).alias("n_fields"), F.when(u % 7 != 0, (u % 10) / 10).alias("stability"))


@query(f"""WITH {EV}, c AS (SELECT user_id AS u, count(*) AS n, max(value) / 50 AS peak FROM ev GROUP BY user_id), v(variant, spikes, peak_hz, stab) AS (VALUES ('base', 50, 1.0, 0.3), ('strict', 70, 1.0, 0.6), ('peak', 50, 1.98, 0.3))
SELECT variant, u % 2 AS direction, count(DISTINCT u) AS n_cells, count(*) AS n_pairs FROM c, v WHERE n >= spikes AND peak >= peak_hz AND (u % 20) / 200.0 < 0.05 AND u % 3 >= 1 AND u % 7 <> 0 AND (u % 10) / 10.0 >= stab GROUP BY ALL""")
def criteria_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = {"base": {}, "strict": {"min_spikes": 70, "min_stability": 0.6}, "peak": {"min_peak_hz": 1.98}}
    return controls.criteria_sweep(cells(spark, sf_dir), variants, ["direction"])


FITS = """f AS (SELECT m, fold, kind, seed, ((m * 37 + fold * 11 + seed * 5 + (kind = 'real')::INT * 90) % 101)::DOUBLE AS v, ((m * 13 + fold * 29 + seed) % 97)::DOUBLE AS ll
FROM (SELECT range AS m FROM range(2, 8)), (SELECT range AS fold FROM range(3)), (SELECT range AS seed FROM range(4)), (SELECT unnest(['real', 'shuffled']) AS kind))"""


@query(f"""WITH {FITS}, r AS (SELECT m, quantile_cont(v, 0.5) AS v, quantile_cont(ll, 0.5) AS ll FROM f WHERE kind = 'real' GROUP BY m), b AS (SELECT arg_max(m, (v, -m)) AS chosen, arg_max(m, (ll, -m)) AS by_likelihood FROM r),
g AS (SELECT fold, arg_max(m, (v, -m)) AS c FROM (SELECT fold, m, quantile_cont(v, 0.5) AS v FROM f WHERE kind = 'real' GROUP BY ALL) GROUP BY fold)
SELECT chosen, by_likelihood, round((SELECT avg((c = chosen)::INT) FROM g), 6) AS fold_agreement, (SELECT min(v) FILTER (kind = 'real') > max(v) FILTER (kind = 'shuffled') FROM f WHERE m = chosen) AS clear FROM b""")
def choose_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that picks a model size, on a made-up table of fits."""
    r = lambda n, a, b: spark.range(a, b).select(F.col("id").alias(n))
    real = (F.col("kind") == "real").cast("int")
    f = r("n_states", 2, 8).crossJoin(r("fold", 0, 3)).crossJoin(r("seed", 0, 4)).withColumn("kind", F.explode(F.array(F.lit("real"), F.lit("shuffled"))))  # a made-up table of 144 rows
    f = f.withColumn("v", ((F.col("n_states") * 37 + F.col("fold") * 11 + F.col("seed") * 5 + real * 90) % 101).cast("double")).withColumn("ll", ((F.col("n_states") * 13 + F.col("fold") * 29 + F.col("seed")) % 97).cast("double")).withColumn("session", F.lit("s"))
    return controls.choose_size(f, ["session"], "v", "ll").select("chosen", "by_likelihood", r6("fold_agreement", "fold_agreement"), "clear")


@query(f"""WITH {EV}, h AS (SELECT day, bin, count(*) AS n FROM ev GROUP BY ALL), p AS (SELECT *, least(row_number() OVER (PARTITION BY day ORDER BY bin) - 1, 11)::INT AS phase FROM h), m AS (SELECT phase, atan2(sum(sin(2 * pi() * bin / 24)), sum(cos(2 * pi() * bin / 24))) AS a FROM p WHERE day % 3 <> 0 GROUP BY phase),
q AS (SELECT phase, (a / (2 * pi()) * 24 + 24) - floor((a / (2 * pi()) * 24 + 24) / 24) * 24 AS mapped FROM m), e AS (SELECT abs(mapped - bin) - floor(abs(mapped - bin) / 24) * 24 AS d FROM p JOIN q USING (phase) WHERE day % 3 = 0) SELECT count(*) AS n, round(quantile_cont(least(d, 24 - d), 0.5), 5) AS median_error FROM e""")
def phase_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the place in a day's order of hours alone tells the hour."""
    h = events(spark, sf_dir).groupBy("day", "bin").agg(F.count(F.lit(1)).alias("n")).withColumn("session", F.lit("s"))
    p = controls.phase_levels(h, ["session"], "day", "bin")
    mapping = controls.level_map(p.where("day % 3 <> 0"), ["session"], "phase", "bin", 24.0)
    out = controls.mapped_errors(p.where("day % 3 = 0"), mapping, ["session"], "phase", "bin", 24.0)
    return out.select("n", F.round("median_error", 5).alias("median_error"))


@query(f"""WITH {EV}, h AS (SELECT day, bin, count(*) AS n FROM ev GROUP BY ALL), p AS (SELECT *, least(row_number() OVER (PARTITION BY day ORDER BY bin) - 1, 11)::INT AS phase FROM h), m AS (SELECT phase, atan2(sum(sin(2 * pi() * bin / 24)), sum(cos(2 * pi() * bin / 24))) AS a FROM p WHERE day % 3 <> 0 GROUP BY phase),
q AS (SELECT phase, (a / (2 * pi()) * 24 + 24) - floor((a / (2 * pi()) * 24 + 24) / 24) * 24 AS mapped FROM m), a AS (SELECT perm, phase, row_number() OVER (PARTITION BY perm ORDER BY phase) AS k FROM q CROSS JOIN range(20) t(perm)),
b AS (SELECT perm, mapped, row_number() OVER (PARTITION BY perm ORDER BY md5('7:' || perm || ':' || phase), phase) AS k FROM q CROSS JOIN range(20) t(perm)), e AS (SELECT perm, abs(mapped - bin) - floor(abs(mapped - bin) / 24) * 24 AS d FROM p JOIN a USING (phase) JOIN b USING (perm, k) WHERE day % 3 = 0),
r AS (SELECT perm, quantile_cont(least(d, 24 - d), 0.5) AS e FROM e GROUP BY perm) SELECT round(quantile_cont(e, 0.5), 5) AS median_error FROM r""")
def phase_chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under 20 permuted maps."""
    h = events(spark, sf_dir).groupBy("day", "bin").agg(F.count(F.lit(1)).alias("n")).withColumn("session", F.lit("s"))
    p = controls.phase_levels(h, ["session"], "day", "bin")
    mapping = controls.level_map(p.where("day % 3 <> 0"), ["session"], "phase", "bin", 24.0)
    return controls.chance_errors(p.where("day % 3 = 0"), mapping, ["session"], "phase", "bin", 20, 7, 24.0).select(F.round("median_error", 5).alias("median_error"))


DETECTED = f"{EV}, {trace_sql('tr')}, {detect_sql('e', 'tr')}"


@query(f"""WITH {DETECTED}, s AS (SELECT peak AS event_id, greatest(round_even((last + 1 - first) / 0.5, 0), 1)::INT AS n_bins, first * 3600.0 AS a, (last + 1) * 3600.0 AS b FROM e)
SELECT s.event_id, n_bins, count(DISTINCT least(floor((t - a) / 1800), n_bins - 1)) AS n_used, count(DISTINCT user_id) AS n_active, count(user_id) AS n_spikes FROM s LEFT JOIN ev ON t BETWEEN a AND b GROUP BY s.event_id, n_bins""")
def event_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    spikes = ev.select(F.lit("s").alias("session"), F.col("user_id").alias("cluster_id"), "t")
    return controls.event_structure(detected(trace(ev)), spikes, ["session"], 1800.0, width=14400.0).drop("session")


@query(f"""WITH {DETECTED}, a AS (SELECT peak AS event_id, count(DISTINCT user_id) AS n_active FROM e JOIN ev ON us >= first * 3600000000 AND us < (last + 1) * 3600000000 GROUP BY peak) SELECT n_active >= 5 AND n_active >= 0.5 * (SELECT count(DISTINCT user_id) FROM ev) AS decodable, count(*) AS n FROM a GROUP BY 1""")
def decodable_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    n = ev.select("user_id").distinct().count()
    part = detect.participation(detected(trace(ev)), ev.select(F.lit("s").alias("session"), F.col("user_id").alias("cluster_id"), "t"), ["session"], width=14400.0)
    return controls.decodable(part, n, share=0.5).groupBy("decodable").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EV}, a AS (SELECT DISTINCT count(DISTINCT user_id)::INT AS n_active FROM ev GROUP BY day, bin), r AS (SELECT n_active, draw, cell // 10 AS grp, row_number() OVER (PARTITION BY n_active, draw ORDER BY md5('0:' || n_active || ':' || draw || ':' || cell), cell) AS k FROM a CROSS JOIN range(400) t(draw) CROSS JOIN range(150) c(cell)),
g AS (SELECT n_active, draw, grp, count(*) AS n FROM r WHERE k <= n_active GROUP BY ALL), t AS (SELECT n_active, draw, max(n) / least(n_active, 150) AS top FROM g GROUP BY n_active, draw) SELECT n_active, round(avg(top), 6) AS expected FROM t GROUP BY n_active""")
def concentration_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected share of the busiest group by number of active cells, from 400 seeded draws each."""
    n = events(spark, sf_dir).groupBy("day", "bin").agg(F.countDistinct("user_id").alias("n_active"))
    return controls.concentration_null(n, [10] * 15).withColumn("expected", r6("expected"))


@query(f"""WITH {EV}, r AS (SELECT event_type, event_id, value, ntile(4) OVER w AS part FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id)) SELECT event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, part ORDER BY value, event_id) AS k FROM r) WHERE k = 1""")
def spread_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_type", "event_id", "value")
    return reports.spread_examples(rows, ["event_type"], "value", 4, "event_id").withColumn("value", r6("value"))
