"""From a recording's frames to events: the channel, its envelope, events under every kernel and boundary; cut recordings and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import gaussian_weights, smooth_trace
from ..operators import detect, envelopes, movement, validate
from ..operators.chunks import over_chunks
from ..sources.tables import table, written
from .decoding import BANDS, SECTIONS, TENS, tens, zero_phase_sql
from .registry import EV, epoch_of, events, query, r6, values_sql

SIGMAS, LOWS, HIGH, GAP, LEAST, MOST = (0.0, 1.0, 2.0), (0.0, 0.5, 1.0), 2.0, 3, 2, 40
_KERNELS = [(s, k - len(w) // 2, v) for s in SIGMAS for w in [gaussian_weights(s)] for k, v in enumerate(w)]

#: Envelopes of the fast band by convolution with a cotangent kernel; the channel with the largest mean; its trace under each kernel.
ENVELOPES = f"""{EV}, {TENS}, {zero_phase_sql("tr", {"fast": SECTIONS["fast"]})}, n AS (SELECT count(*) AS n FROM tr WHERE channel = 0),
kern AS (SELECT range AS d, (1 / tan(pi() * range / n) - CASE WHEN n % 2 = 0 THEN (CASE WHEN range % 2 = 0 THEN 1 ELSE -1 END) / tan(pi() * range / n) ELSE (CASE WHEN range % 2 = 0 THEN 1 ELSE -1 END) / sin(pi() * range / n) END) / n AS h FROM n, range(1, (SELECT n FROM n))),
im AS (SELECT channel, (k + d) % n AS k, sum(v * h) AS w FROM filtered CROSS JOIN kern CROSS JOIN n WHERE abs(h) > 0 GROUP BY ALL), env AS (SELECT channel, k, sqrt(v * v + w * w)::FLOAT::DOUBLE AS e FROM filtered JOIN im USING (channel, k)),
best AS (SELECT arg_max(channel, (round(m, 4), -channel)) AS channel FROM (SELECT channel, avg(e) AS m FROM env GROUP BY channel)), lo AS (SELECT min(i) AS i FROM tr),
one AS MATERIALIZED (SELECT lo.i + k AS i, round(e, 3) AS e FROM env JOIN best USING (channel) CROSS JOIN lo), span AS (SELECT min(i) AS a, max(i) AS z FROM one),
sm AS MATERIALIZED (SELECT s AS sigma, a.i, round(sum(w * b.e), 4) AS v FROM one a CROSS JOIN span CROSS JOIN {values_sql(_KERNELS, "g(s, k, w)")} JOIN one b ON b.i = greatest(least(a.i + k, z), span.a) GROUP BY s, a.i)"""


def best_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, i, v: the fast-band envelope of the channel where it is largest on average; made once, whatever is asked of it."""
    each = written(envelopes.channel_envelope(tens(spark, sf_dir), list(range(8)), rate_hz=1.0, band=BANDS["fast"]), "envelopes")
    means = each.groupBy("session", "channel").agg(F.round(F.avg("v"), 4).alias("m"))
    best = means.groupBy("session").agg(F.max_by("channel", F.struct("m", -F.col("channel"))).alias("channel"))
    return written(each.join(best, ["session", "channel"], "left_semi").select("session", "i", F.round(F.col("v").cast("double"), 3).alias("e")), "envelope")


def smoothed(envelope: DataFrame) -> DataFrame:
    """session, sigma, i, v of each kernel, in chunks of a thousand samples. Beyond the trace's ends its end values go on."""
    out = None
    for sigma in SIGMAS:
        reach = len(gaussian_weights(sigma)) // 2
        made = over_chunks(envelope, lambda rows, keys, sigma=sigma: smooth_trace(rows, "e", keys, "i", sigma, out="v"), ["session"], "i", 1000, max(reach, 1)) if sigma else envelope.withColumn("v", F.col("e"))
        part = made.select("session", F.lit(sigma).alias("sigma"), "i", F.round("v", 4).alias("v"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH RECURSIVE {ENVELOPES}, b AS (SELECT sigma, avg(v) AS m, stddev_pop(v) AS s FROM sm GROUP BY sigma), f AS (SELECT sm.sigma, low.low, i, v, v >= round(m + low.low * s, 6) AS lo, v >= round(m + {HIGH} * s, 6) AS hi FROM sm JOIN b USING (sigma) CROSS JOIN (SELECT unnest([{", ".join(f"{x!r}::DOUBLE" for x in LOWS)}]) AS low) low),
r AS (SELECT sigma, low, min(i) AS a, max(i) AS z FROM (SELECT *, i - row_number() OVER (PARTITION BY sigma, low ORDER BY i) AS island FROM f WHERE lo) GROUP BY sigma, low, island HAVING bool_or(hi)),
e AS (SELECT sigma, low, min(a) AS first, max(z) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY sigma, low ORDER BY a) AS ev FROM (SELECT *, CASE WHEN a - lag(z) OVER (PARTITION BY sigma, low ORDER BY a) < {GAP} THEN 0 ELSE 1 END AS new FROM r)) GROUP BY sigma, low, ev)
SELECT sigma::DOUBLE AS sigma, low, count(*) AS n_events, quantile_cont(last - first + 1, 0.5) AS median_samples FROM e WHERE last - first + 1 BETWEEN {LEAST} AND {MOST} GROUP BY sigma, low""")
def kernel_and_boundary_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under every smoothing kernel and lower boundary, all from one envelope of the best channel, in one detection."""
    trace = smoothed(best_envelope(spark, sf_dir))
    base = written(detect.baseline(trace, ["session", "sigma"]), "baseline")
    fan = trace.join(base, ["session", "sigma"]).withColumn("low", F.explode(F.array(*map(F.lit, LOWS)))).withColumn("t", F.col("i").cast("double"))
    low, high = (F.round(F.col("mean") + k * F.col("sd"), 6) for k in (F.col("low"), F.lit(HIGH)))
    found = detect.two_threshold(fan, ["session", "sigma", "low"], low=low, high=high, merge_gap=float(GAP), min_duration=float(LEAST), max_duration=float(MOST), dt=1.0)
    return found.groupBy("sigma", "low").agg(F.count(F.lit(1)).alias("n_events"), F.percentile(F.col("end") - F.col("start"), 0.5).alias("median_samples"))


@query(f"""WITH {EV}, sp AS (SELECT 'S' || (user_id % 5) AS session, user_id, t FROM ev), lim AS (SELECT 'S' || range AS session, (18 + range) * 86400.0 AS lim FROM range(5))
SELECT session, count(*) AS n_total, count(*) FILTER (t > lim) AS n_dropped, count(DISTINCT CASE WHEN t > lim THEN user_id END) AS n_clusters, round(greatest(max(t) - any_value(lim), 0), 5)::DOUBLE AS seconds_beyond, round(count(*) FILTER (t > lim) / count(*), 6) AS fraction_dropped,
(SELECT count(*) FROM (SELECT session AS s, least(day // 10, 2) AS k, min(t) AS a FROM sp JOIN ev USING (user_id, t) GROUP BY ALL) e WHERE e.s = sp.session AND e.a < any_value(lim.lim)) AS n_epochs FROM sp JOIN lim USING (session) GROUP BY session""")
def truncated_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings cut where their session ends: what goes, and how many epochs are left."""
    ev = events(spark, sf_dir).withColumn("session", F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")))
    spikes = ev.select("session", F.col("user_id").alias("cluster_id"), "t")
    epochs = ev.groupBy("session", epoch_of().alias("epoch")).agg(F.min("t").alias("start"), F.max("t").alias("end"))
    sessions = ev.select("session").distinct().withColumn("sess_duration", (18 + F.substring("session", 2, 1).cast("int")) * 86_400.0)
    states = epochs.withColumnRenamed("epoch", "state")
    _, _, kept, report = validate.truncate(spikes, states, epochs, sessions)
    left = kept.groupBy("session").agg(F.count(F.lit(1)).alias("n_epochs"))
    return report.join(left, "session", "left").select("session", "n_total", "n_dropped", "n_clusters", F.round("seconds_beyond", 5).alias("seconds_beyond"), r6("fraction_dropped", "fraction_dropped"), "n_epochs")


@query("""WITH p AS (SELECT l_returnflag AS session, l_orderkey * 10 + l_linenumber AS sample, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE / 1000 AS y FROM lineitem), c AS (SELECT session, avg(x) AS mx, avg(y) AS my, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS a FROM p GROUP BY session),
j AS (SELECT session, sample, x, (x - mx) * cos(a) + (y - my) * sin(a) AS u FROM p JOIN c USING (session)), d AS (SELECT session, CASE WHEN covar_pop(u, 60 - x) < 0 THEN -1 ELSE 1 END AS d FROM j GROUP BY session)
SELECT session, sample, round(u * d - min(u * d) OVER (PARTITION BY session), 4) AS x1d FROM j JOIN d USING (session)""")
def linearized_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a plane as places along their principal axis, in the direction of a rough position that falls with x."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("session"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice").cast("double") / 1000).alias("y")).withColumn("x1d", 60 - F.col("x"))
    return movement.linearize_2d(p, "linear").select("session", "sample", F.round("x1d", 4).alias("x1d"))
