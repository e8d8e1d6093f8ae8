"""Scans, units, sets, upserts, windows and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import detect, intervals, islands, movement
from ..operators.envelopes import select_per_group
from ..schema import shank_of
from ..sources.tables import rounded, significant, table, union_widened, upserted
from .registry import DAY_US, EPOCH, EV, days, epoch_of, events, query, r6


@query(f"""WITH {EV} SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS n_types FROM ev
WHERE us >= 3 * 86400000000 + 6 * 3600000000 AND us < 5 * 86400000000 + 18 * 3600000000 GROUP BY user_id""")
def spikes_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A half-open range scan by the raw timestamp, so that row groups can be skipped."""
    rows = table(spark, sf_dir, "events").where("ts >= TIMESTAMP_NTZ'2024-01-04 06:00:00' and ts < TIMESTAMP_NTZ'2024-01-06 18:00:00'")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("n_types"))


@query(f"""WITH {EV}, units AS (SELECT user_id, user_id // 10 AS shank, CASE WHEN user_id % 2 = 0 THEN 'pyr' ELSE 'int' END AS kind, count(*) AS n FROM ev GROUP BY user_id)
SELECT shank::INT AS shank, kind, count(*) AS n_units, sum(n)::BIGINT AS n_spikes, min(n) AS least, max(n) AS most FROM units GROUP BY shank, kind""")
def unit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("shank", shank_of(F.col("user_id"), 10)).withColumn("kind", F.when(F.col("user_id") % 2 == 0, "pyr").otherwise("int"))
    return units.groupBy("shank", "kind").agg(F.count(F.lit(1)).alias("n_units"), F.sum("n").alias("n_spikes"), F.min("n").alias("least"), F.max("n").alias("most"))


@query(f"""WITH {EV}, a AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'error'), b AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'purchase')
SELECT 'union' AS op, user_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', user_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'difference', user_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def set_ops_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    a, b = (ev.where(F.col("event_type") == k).select("user_id").distinct() for k in ("error", "purchase"))
    return union_widened([df.select(F.lit(op).alias("op"), "user_id") for op, df in (("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("difference", a.subtract(b)))])


@query(f"""WITH {EV}, w AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM ev)
SELECT code, severity, n FROM (
SELECT 'spike_times_unsorted' AS code, 'error' AS severity, count(*) FILTER (step < 0) AS n FROM w UNION ALL
SELECT 'spikes_after_session_end', 'warning', count(*) FILTER (us > 25 * 86400000000) FROM w UNION ALL
SELECT 'clusters_after_session_end', 'warning', count(DISTINCT user_id) FILTER (us > 25 * 86400000000) FROM w UNION ALL
SELECT 'spike_times_nonfinite', 'error', count(*) FILTER (us IS NULL) FROM w UNION ALL
SELECT 'negative_values', 'warning', count(*) FILTER (value < 0) FROM w) WHERE n > 0""")
def validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aggregation pass gives all findings."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    late = F.col("us") > 25 * DAY_US
    rows = events(spark, sf_dir).withColumn("step", F.col("us") - F.lag("us").over(w))
    agg = rows.agg(F.count_if(F.col("step") < 0).alias("a"), F.count_if(late).alias("b"), F.countDistinct(F.when(late, F.col("user_id"))).alias("c"), F.count_if(F.col("us").isNull()).alias("d"), F.count_if(F.col("value") < 0).alias("e"))
    named = (("spike_times_unsorted", "error", "a"), ("spikes_after_session_end", "warning", "b"), ("clusters_after_session_end", "warning", "c"), ("spike_times_nonfinite", "error", "d"), ("negative_values", "warning", "e"))
    return agg.select(F.explode(F.array(*(F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.col(c).alias("n")) for code, sev, c in named))).alias("x")).select("x.*").where("n > 0")


@query(f"""WITH {EV}, old AS (SELECT user_id, count(*) AS n, min(value) AS low FROM ev WHERE day < 20 GROUP BY user_id),
new AS (SELECT user_id, count(*) AS n, max(value) AS high FROM ev WHERE day >= 27 AND user_id % 3 = 0 GROUP BY user_id)
SELECT user_id, n, round(low, 6) AS low, NULL::DOUBLE AS high FROM old WHERE user_id % 7 <> 0 AND user_id NOT IN (SELECT user_id FROM new)
UNION ALL SELECT user_id, n, NULL, round(high, 6) FROM new""")
def session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows replace those of their key, cleared keys go, columns of both sides stay."""
    ev = events(spark, sf_dir)
    old = ev.where("day < 20").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r6(F.min("value"), "low"))
    new = ev.where("day >= 27 and user_id % 3 = 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r6(F.max("value"), "high"))
    cleared = ev.where("user_id % 7 = 0").select("user_id").distinct()
    return upserted(old, new, ["user_id"], cleared).select("user_id", "n", "low", "high")


@query(f"""WITH {EV}, w AS (SELECT user_id, event_id, CASE WHEN value > lag(value) OVER o OR lag(value) OVER o IS NULL THEN 1 ELSE 0 END AS up FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT user_id, min(up) OVER (PARTITION BY user_id ORDER BY event_us, event_id ROWS UNBOUNDED PRECEDING) AS still FROM (SELECT w.*, ev.us AS event_us FROM w JOIN ev USING (user_id, event_id)))
SELECT user_id, sum(still)::BIGINT AS n FROM s GROUP BY user_id""")
def monotone_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).select("user_id", "value", F.struct("us", "event_id").alias("at"))
    return islands.leading_monotone_run(ev, ["user_id"], "at", "value")


@query(f"""WITH {EV}, g AS (SELECT event_type, floor(value)::BIGINT AS level, count(*) AS n FROM ev GROUP BY ALL)
SELECT event_type, level, n, round(sum(n) OVER (PARTITION BY event_type ORDER BY level) / sum(n) OVER (PARTITION BY event_type), 6) AS share FROM g""")
def cumulative_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative distribution by level: counted first, so the window has a row for each level only."""
    g = events(spark, sf_dir).groupBy("event_type", F.floor("value").cast("long").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type")
    return g.withColumn("share", r6(F.sum("n").over(w.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("n").over(w)))


@query(f"""WITH {EV}, p AS (SELECT day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view FROM ev GROUP BY day),
s AS (SELECT day, count(DISTINCT user_id) AS users FROM ev WHERE event_type = 'signup' AND value > 50 GROUP BY day) SELECT day, click, error, view, users FROM p LEFT JOIN s USING (day)""")
def pivot_orderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    kinds = ["click", "error", "view"]
    p = ev.groupBy("day").pivot("event_type", kinds).count().fillna(0, kinds)
    return p.join(ev.where("event_type = 'signup' and value > 50").groupBy("day").agg(F.countDistinct("user_id").alias("users")), "day", "left")


@query(f"""WITH {EV} SELECT {EPOCH} AS epoch, event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM ev
GROUP BY GROUPING SETS (({EPOCH}, event_type), (event_type), ())""")
def pooled_and_group_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians can't be pooled from medians: each grouping set goes over the rows."""
    ev = events(spark, sf_dir).withColumn("epoch", epoch_of())
    sets = ev.groupingSets([["epoch", "event_type"], ["event_type"], []], "epoch", "event_type")
    return sets.agg(F.count(F.lit(1)).alias("n"), r6(F.percentile("value", 0.5), "median"), r6(F.percentile("value", 0.9), "p90")).select("epoch", "event_type", "n", "median", "p90")


@query(f"""WITH {EV}, p AS (SELECT user_id // 10 AS shank, user_id, round(avg(value), 6) AS mean FROM ev GROUP BY user_id),
r AS (SELECT *, row_number() OVER o AS k, lead(mean) OVER o AS runner_up FROM p WINDOW o AS (PARTITION BY shank ORDER BY mean DESC, user_id))
SELECT shank::INT AS shank, user_id AS channel, mean, runner_up, round((mean - runner_up) / nullif(mean, 0), 6) AS margin FROM r WHERE k = 1""")
def best_channel_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = events(spark, sf_dir).groupBy(F.col("user_id").alias("channel")).agg(r6(F.avg("value"), "mean"))
    channels = profile.select("channel", shank_of(F.col("channel"), 10).alias("shank"), F.col("channel").alias("pos"), F.lit(False).alias("skip"))
    return select_per_group(profile, channels, [], "mean").withColumn("margin", r6("margin"))


@query(f"""WITH {EV}, iv AS (SELECT d AS day, d * 86400.0 AS s, d * 86400.0 + (1 + d % 5) * 3600.0 AS e FROM days t(d)),
r AS (SELECT *, e - s - 5400 AS room FROM iv WHERE e - s - 5400 >= 0), c AS (SELECT *, sum(room) OVER (ORDER BY s) AS upto, sum(room) OVER () AS total FROM r),
k AS (SELECT k::INT AS k, (k + 0.5) / 40 AS share FROM range(40) t(k))
SELECT k, round(s + share * total - (upto - room), 6)::DOUBLE AS start, round(s + share * total - (upto - room) + 5400, 6)::DOUBLE AS "end" FROM c, k WHERE share * total >= upto - room AND share * total < upto""")
def sample_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 windows of 90 minutes over the nights of all days."""
    d = F.col("day").cast("double")
    nights = days(events(spark, sf_dir)).select(F.lit("s").alias("session"), (d * 86400.0).alias("start"), (d * 86400.0 + (1 + F.col("day") % 5) * 3600.0).alias("end"))
    return detect.sample_windows(nights, ["session"], 5400.0, 40).select("k", r6("start", "start"), r6("end", "end"))


@query("""WITH c AS (SELECT l_returnflag, avg(l_quantity) AS mx, avg(l_extendedprice / 1000) AS my, var_pop(l_quantity) AS a, covar_pop(l_quantity, l_extendedprice / 1000) AS b, var_pop(l_extendedprice / 1000) AS c FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(mx, 4) AS mx, round(my, 4) AS my, round(cos(atan2(2 * b, a - c) / 2), 4) AS ax, round(sin(atan2(2 * b, a - c) / 2), 4) AS ay, round((a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b), 3) AS variance FROM c""")
def pca_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"))
    out = movement.principal_axis(rows, "l_quantity", "price", ["l_returnflag"])
    return out.select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("mx", "my", "ax", "ay")), F.round("variance", 3).alias("variance"))


@query(f"""WITH {EV}, l AS (SELECT event_type, covar_pop(value, bin) / nullif(var_pop(bin), 0) AS slope, avg(value) AS my, avg(bin) AS mx FROM ev GROUP BY event_type), f AS (SELECT *, my - slope * mx AS intercept FROM l)
SELECT event_type, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(max(abs(value - slope * bin - intercept)), 5) AS max_residual FROM ev JOIN f USING (event_type) GROUP BY ALL""")
def affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = movement.affine_fit(events(spark, sf_dir), ["event_type"], "value", "bin")
    return out.select("event_type", r6("slope", "slope"), r6("intercept", "intercept"), F.round("max_residual", 5).alias("max_residual"))


@query(f"""WITH {EV}, iv AS (SELECT d, d::BIGINT * 86400000000 AS s, d::BIGINT * 86400000000 + 6 * 3600000000 AS e FROM days t(d)), n AS (SELECT user_id, count(*) AS n FROM ev JOIN iv ON us BETWEEN s AND e GROUP BY user_id)
SELECT user_id, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) * 21600.0 FROM days), 9) AS rate FROM (SELECT DISTINCT user_id FROM ev) LEFT JOIN n USING (user_id)""")
def rate_in_closed_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).select(F.lit("s").alias("session"), "user_id", "t")
    nights = days(events(spark, sf_dir)).select(F.lit("s").alias("session"), (F.col("day") * 86400.0).alias("start"), (F.col("day") * 86400.0 + 21600.0).alias("end"))
    return intervals.rate_in_intervals(ev, nights, ["session"], ["user_id"], width=21600.0).select("user_id", "n", F.round("rate", 9).alias("rate"))


# --- joins, aggregates and functions on the order tables ------------------------------------------


@query("""SELECT n_name, r_name, count(*) AS n_orders, count(DISTINCT c_custkey) AS n_customers, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""")
def lookup_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are summed by customer before they meet the small tables, which the planner may broadcast by their size."""
    t = lambda n: table(spark, sf_dir, n)
    by = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    named = by.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("n_name", "r_name").agg(F.sum("n").alias("n_orders"), F.count(F.lit(1)).alias("n_customers"), F.round(F.sum("s"), 2).alias("total"))


@query("""SELECT 'semi' AS kind, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
UNION ALL SELECT 'anti', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
UNION ALL SELECT 'left', count(*) FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey""")
def semi_anti_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    on = F.col("o_custkey") == F.col("c_custkey")
    return union_widened([c.join(o, on, how).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, how in (("semi", "left_semi"), ("anti", "left_anti"), ("left", "left"))])


@query("""WITH k AS (SELECT g::BIGINT AS pos, (g * 37 + 5) % 160 AS custkey FROM range(120) t(g)) SELECT pos, custkey, c_name, round(c_acctbal, 2) AS balance FROM k LEFT JOIN customer ON c_custkey = custkey""")
def reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for a given list of keys, in its order; missing keys have NULLs."""
    keys = spark.range(120).select(F.col("id").alias("pos"), ((F.col("id") * 37 + 5) % 160).alias("custkey"))
    return keys.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("custkey"), "left").select("pos", "custkey", "c_name", F.round("c_acctbal", 2).alias("balance"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS weighted, round(avg(l_discount), 6) AS mean,
round(stddev_pop(l_quantity), 6) AS sd_pop, round(stddev_samp(l_quantity), 6) AS sd_samp, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS q2, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3,
round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.percentile("l_extendedprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    agg = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.round(F.try_divide(F.sum(F.col("l_quantity") * F.col("l_extendedprice")), F.sum("l_quantity")), 4).alias("weighted"), r6(F.avg("l_discount"), "mean"),
        r6(F.stddev_pop("l_quantity"), "sd_pop"), r6(F.stddev_samp("l_quantity"), "sd_samp"), q.alias("_q"), r6(F.corr("l_quantity", "l_extendedprice"), "r"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"),
    )
    return agg.select("l_returnflag", "l_linestatus", "n", "suppliers", "weighted", "mean", "sd_pop", "sd_samp", *(F.round(F.get("_q", F.lit(i)), 4).alias(f"q{i + 1}") for i in range(3)), "r", "slope")


@query("""SELECT p_partkey, regexp_extract(p_name, '([0-9]+)', 1) AS digits, lower(p_brand) AS brand, CASE WHEN contains(lower(p_type), 'a') THEN 1 ELSE 0 END AS has_a, split_part(p_type, ' ', 1) AS head,
round_even(p_retailprice, 1) AS half_even, round(ln(p_retailprice), 6) AS ln_price, round(log2(p_retailprice), 6) AS log2_price, round(sqrt(p_retailprice), 6) AS root, round(sqrt(p_size * p_size + p_retailprice * p_retailprice), 4) AS hypot,
round(atan2(p_size, p_retailprice), 8) AS angle, ((p_size - 25) % 7 + 7) % 7 AS ring, (p_size // 4)::INT AS quarter, printf('%.2e', ln(p_retailprice))::DOUBLE AS figures FROM part""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.regexp_extract("p_name", "([0-9]+)", 1).alias("digits"), F.lower("p_brand").alias("brand"), F.lower("p_type").contains("a").cast("int").alias("has_a"), F.substring_index("p_type", " ", 1).alias("head"),
        F.bround(price, 1).alias("half_even"), r6(F.log(price), "ln_price"), r6(F.log2(price), "log2_price"), r6(F.sqrt(price), "root"), F.round(F.hypot(size.cast("double"), price), 4).alias("hypot"),
        F.round(F.atan2(size.cast("double"), price), 8).alias("angle"), F.pmod(size - 25, F.lit(7)).alias("ring"), F.floor(size / 4).cast("int").alias("quarter"), significant(F.log(price)).alias("figures"),
    )


@query("""WITH s AS (SELECT s_nationkey, s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier) SELECT place, s_suppkey, s_nationkey, round(s_acctbal, 2) AS balance FROM s WHERE place <= 25""")
def top_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k: the limit is found in each partition first, and only k rows get a number."""
    top = table(spark, sf_dir, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(25)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("s_acctbal"), "s_suppkey"))).select(F.col("place").cast("long"), "s_suppkey", "s_nationkey", F.round("s_acctbal", 2).alias("balance"))


@query(f"""WITH {EV} SELECT {EPOCH} AS epoch, event_type, count(*) AS n, round_even(avg(value), 5) AS mean, printf('%.2e', min(value))::DOUBLE AS least FROM ev WHERE value > 0 GROUP BY 1, 2""")
def rounded_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).where("value > 0").withColumn("epoch", epoch_of())
    return rounded(ev.groupBy("epoch", "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least")), significant_columns=("least",))

