"""Rank tests, splits, empirical p, circular statistics, levels and neighbours."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import percentiles, ranks
from .registry import EV, events, query, r6

RANKS = """rk AS (SELECT epoch, g, x, rank() OVER (PARTITION BY epoch ORDER BY x) + (count(*) OVER (PARTITION BY epoch, x) - 1) / 2.0 AS r FROM d),
tie AS (SELECT epoch, sum(t * t * t - t) AS ties FROM (SELECT epoch, x, count(*)::DOUBLE AS t FROM d GROUP BY ALL) GROUP BY epoch),
u AS (SELECT epoch, count(*) FILTER (g = 'error') AS n1, count(*) FILTER (g = 'view') AS n2, sum(r) FILTER (g = 'error') AS r1 FROM rk GROUP BY epoch)"""
TWO = "d AS (SELECT CASE WHEN day < 10 THEN 'PRE' WHEN day < 20 THEN 'MAZE' ELSE 'POST' END AS epoch, event_type AS g, floor(value)::BIGINT AS x FROM ev WHERE event_type IN ('error', 'view'))"


def two_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .registry import epoch_of

    return events(spark, sf_dir).where("event_type in ('error', 'view')").select(epoch_of().alias("epoch"), F.col("event_type").alias("g"), F.floor("value").cast("double").alias("x"))


@query(f"""WITH {EV}, {TWO}, {RANKS}, v AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u FROM u JOIN tie USING (epoch))
SELECT epoch, n1, n2, round(u, 3) AS u, round(2 * u / (n1 * n2) - 1, 6) AS rank_biserial, round(greatest(abs(u - n1 * n2 / 2.0) - 0.5, 0) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0)))), 6) AS z FROM v""")
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values are counted before they are ranked, so a window row is a distinct value."""
    out = ranks.mann_whitney(two_groups(spark, sf_dir), ["epoch"], "g", "x", "error", "view")
    return out.select("epoch", "n1", "n2", F.round("u", 3).alias("u"), r6("rank_biserial", "rank_biserial"), r6("z", "z"))


@query(f"""WITH {EV}, {TWO}, c AS (SELECT epoch, x, sum(count(*) FILTER (g = 'error')) OVER (PARTITION BY epoch ORDER BY x) / sum(count(*) FILTER (g = 'error')) OVER (PARTITION BY epoch) - sum(count(*) FILTER (g = 'view')) OVER (PARTITION BY epoch ORDER BY x) / sum(count(*) FILTER (g = 'view')) OVER (PARTITION BY epoch) AS gap FROM d GROUP BY epoch, x)
SELECT c.epoch, any_value(n1) AS n1, any_value(n2) AS n2, round(max(abs(gap)), 6) AS d FROM c JOIN (SELECT epoch, count(*) FILTER (g = 'error') AS n1, count(*) FILTER (g = 'view') AS n2 FROM d GROUP BY epoch) USING (epoch) GROUP BY c.epoch""")
def ks_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.ks_statistic(two_groups(spark, sf_dir), ["epoch"], "g", "x", "error", "view").withColumn("d", r6("d"))


@query(f"""WITH {EV}, {TWO},
w AS (SELECT a.epoch, sum(CASE WHEN a.x >= b.x THEN a.n * b.n ELSE 0 END) / sum(a.n * b.n) AS share FROM (SELECT epoch, x, count(*) AS n FROM d WHERE g = 'error' GROUP BY ALL) a JOIN (SELECT epoch, x, count(*) AS n FROM d WHERE g = 'view' GROUP BY ALL) b ON a.epoch = b.epoch GROUP BY a.epoch)
SELECT epoch, round(share, 6) AS share FROM w""")
def exceedance_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all pairs of the two groups, from ranks: no pair is ever made."""
    return ranks.exceedance_share(two_groups(spark, sf_dir), ["epoch"], "g", "x", "error", "view").withColumn("share", r6("share"))


UNIT = "m AS (SELECT user_id // 50 AS grp, user_id, round(avg(value), 6) AS rate FROM ev GROUP BY user_id)"
HALVES = "h AS (SELECT grp, user_id, rate, CASE WHEN r <= n // 2 THEN 'low' WHEN r > n - n // 2 THEN 'high' END AS half FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rate, user_id) AS r, count(*) OVER (PARTITION BY grp) AS n FROM m))"


def unit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.floor(F.col("user_id") / 50).alias("grp"), "user_id").agg(r6(F.avg("value"), "rate"))


@query(f"WITH {EV}, {UNIT}, {HALVES} SELECT grp, user_id, half FROM h WHERE half IS NOT NULL")
def equal_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.equal_halves(unit_rates(spark, sf_dir), ["grp"], "rate", "user_id").select("grp", "user_id", "half")


@query(f"""WITH {EV}, {UNIT}, {HALVES}, n AS (SELECT user_id // 50 AS grp, user_id, count(*) AS rate FROM ev GROUP BY user_id), k AS (SELECT grp, user_id, CASE WHEN r <= n // 2 THEN 'low' WHEN r > n - n // 2 THEN 'high' END AS half FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rate, user_id) AS r, count(*) OVER (PARTITION BY grp) AS n FROM n))
SELECT h.grp, count(*) AS n, round(greatest(avg((h.half = k.half)::INT), 1 - avg((h.half = k.half)::INT)), 6) AS agreement FROM h JOIN k ON h.grp = k.grp AND h.user_id = k.user_id WHERE h.half IS NOT NULL AND k.half IS NOT NULL GROUP BY h.grp""")
def split_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = events(spark, sf_dir).groupBy(F.floor(F.col("user_id") / 50).alias("grp"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    a, b = ranks.equal_halves(unit_rates(spark, sf_dir), ["grp"], "rate", "user_id"), ranks.equal_halves(n, ["grp"], "n", "user_id")
    return ranks.split_agreement(a, b, ["grp"], "user_id").withColumn("agreement", r6("agreement"))


@query(f"""WITH {EV}, o AS (SELECT user_id, round(avg(value) - 50, 6) AS obs FROM ev GROUP BY user_id), d AS (SELECT user_id, round(avg(value) - 50, 6) AS draw FROM ev GROUP BY user_id, day)
SELECT user_id, count(*) AS n, round((1 + count(*) FILTER (abs(draw) >= abs(obs))) / (1.0 + count(*)), 6) AS p FROM o JOIN d USING (user_id) GROUP BY user_id, obs""")
def empirical_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    obs = ev.groupBy("user_id").agg(F.round(F.avg("value") - 50, 6).alias("obs"))
    draws = ev.groupBy("user_id", "day").agg(F.round(F.avg("value") - 50, 6).alias("draw"))
    return ranks.empirical_p(draws.join(obs, "user_id"), ["user_id"], "obs", "draw").withColumn("p", r6("p"))


ANGLES = "q AS (SELECT event_type, 2 * pi() * (us % 86400000000) / 86400000000 AS a, 2 * pi() * value / 100 AS b, value AS x FROM ev)"


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_type", (2 * math.pi * (F.col("us") % 86_400_000_000) / 86_400_000_000).alias("a"), (2 * math.pi * F.col("value") / 100).alias("b"), F.col("value").alias("x"))


@query(f"""WITH {EV}, {ANGLES}, m AS (SELECT event_type, atan2(avg(sin(a)), avg(cos(a))) AS ma, atan2(avg(sin(b)), avg(cos(b))) AS mb, count(*) AS n FROM q GROUP BY event_type)
SELECT event_type, any_value(n) AS n, round(sum(sin(a - ma) * sin(b - mb)) / sqrt(sum(sin(a - ma) ** 2) * sum(sin(b - mb) ** 2)), 6) AS r FROM q JOIN m USING (event_type) GROUP BY event_type""")
def circular_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.circular_correlation(angles(spark, sf_dir), ["event_type"], "a", "b").withColumn("r", r6("r"))


@query(f"""WITH {EV}, {ANGLES}, c AS (SELECT event_type, count(*) AS n, corr(x, cos(a)) AS xc, corr(x, sin(a)) AS xs, corr(cos(a), sin(a)) AS cs FROM q GROUP BY event_type) SELECT event_type, n, round(sqrt((xc * xc + xs * xs - 2 * xc * xs * cs) / (1 - cs * cs)), 6) AS r FROM c""")
def circular_linear_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.circular_linear_correlation(angles(spark, sf_dir), ["event_type"], "a", "x").withColumn("r", r6("r"))


LEVELS = ", ".join(f"{k / 6!r}" for k in range(1, 6))


@query(f"""WITH {EV}, h AS (SELECT us // 3600000000 AS i, count(*) AS n, avg(value) AS x FROM ev GROUP BY 1), e AS (SELECT quantile_cont(n, [{LEVELS}]) AS e FROM h WHERE i % 3 <> 0), l AS (SELECT h.*, len(list_filter(e, lambda z: z <= n)) AS level FROM h, e),
t AS (SELECT level, avg(x) AS mapped FROM l WHERE i % 3 <> 0 GROUP BY level) SELECT level::INT AS level, count(*) AS n, round(avg(abs(x - mapped)), 6) AS error FROM l JOIN t USING (level) WHERE i % 3 = 0 GROUP BY level""")
def quantile_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels cut at quantiles of the training hours only; each level predicts its training mean for the held-out hours."""
    h = events(spark, sf_dir).groupBy(F.floor(F.col("us") / 3_600_000_000).alias("i")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("x"))
    edges = h.where("i % 3 <> 0").agg(F.percentile("n", F.array(*(F.lit(k / 6) for k in range(1, 6)))).alias("e"))
    rows = h.crossJoin(F.broadcast(edges)).withColumn("level", F.size(F.filter("e", lambda z: z <= F.col("n"))))  # one row
    mapped = rows.where("i % 3 <> 0").groupBy("level").agg(F.avg("x").alias("mapped"))
    return rows.where("i % 3 = 0").join(mapped, "level").groupBy("level").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.abs(F.col("x") - F.col("mapped"))), "error"))


def nearest_vectors(test: DataFrame, train: DataFrame, block: int = 2048) -> DataFrame:
    """i, j, d: for each whole-number vector v of ``test`` (i, v) the nearest w of ``train`` (j, w) by squared distance, the smallest j of ties.

    Both sides are dealt into blocks; a task has one of each, and a row for each of its test vectors leaves it.
    """
    parts = lambda df: max(1, -(-df.count() // block))
    n, m = parts(test), parts(train)
    left = test.select("i", "v", F.pmod(F.xxhash64("i"), F.lit(n)).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("b"))
    right = train.select("j", "w", F.pmod(F.xxhash64("j"), F.lit(m)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("a"))

    def near(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"i": [], "j": [], "d": []}).astype("int64")
        y = y.sort_values("j")
        v, w = np.stack(x["v"]).astype(np.int64), np.stack(y["w"]).astype(np.int64)
        d = (v**2).sum(axis=1)[:, None] + (w**2).sum(axis=1) - 2 * (v @ w.T)
        at = d.argmin(axis=1)
        return pd.DataFrame({"i": x["i"].to_numpy(), "j": y["j"].to_numpy()[at], "d": d[np.arange(len(v)), at]})

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(near, "i long, j long, d long")
    return found.groupBy("i").agg(F.min(F.struct("d", "j")).alias("x")).select("i", "x.j", "x.d")


@query(f"""WITH {EV}, c AS (SELECT us // 10800000000 AS i, user_id % 12 AS cell, count(*) AS n FROM ev GROUP BY ALL), g AS (SELECT DISTINCT i FROM c), v AS (SELECT g.i, list_sort(list(coalesce(n, 0))) AS v FROM g CROSS JOIN (SELECT range AS cell FROM range(12)) k LEFT JOIN c USING (i, cell) GROUP BY g.i),
p AS (SELECT a.i AS i, b.i AS j, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v a CROSS JOIN v b WHERE a.i % 3 = 0 AND b.i % 3 <> 0) SELECT i, arg_min(j, (d, j)) AS nearest, min(d) AS distance FROM p GROUP BY i""")
def sorted_count_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest training vector of sorted counts for each held-out bin. Equal vectors are compared once; a month of bins is one row a bin, not a row a pair of events."""
    ev = events(spark, sf_dir)
    c = ev.groupBy(F.floor(F.col("us") / 10_800_000_000).alias("i"), (F.col("user_id") % 12).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    v = c.groupBy("i").agg(F.collect_list("n").alias("_n")).select("i", F.array_sort(F.concat("_n", F.array_repeat(F.lit(0).cast("long"), F.lit(12) - F.size("_n")))).alias("v"))
    train = v.where("i % 3 <> 0").groupBy("v").agg(F.min("i").alias("j")).withColumnRenamed("v", "w")
    test = v.where("i % 3 = 0")
    return nearest_vectors(test, train).select("i", F.col("j").alias("nearest"), F.col("d").alias("distance"))


@query(f"""WITH {EV} SELECT event_type, count(value) AS n, {", ".join(f"round(quantile_cont(value, {q}), 6) AS p{round(1000 * q)}" for q in (0.001, 0.25, 0.5, 0.999))} FROM ev GROUP BY event_type""")
def exact_value_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by refined histograms: a type may hold any share of all rows."""
    out = percentiles.exact_percentiles(events(spark, sf_dir), ["event_type"], "value", [0.001, 0.25, 0.5, 0.999], parts=64, few=100)
    return out.select("event_type", "n", *(F.round(F.col("percentiles")[k], 6).alias(f"p{n}") for k, n in enumerate((1, 250, 500, 999))))
