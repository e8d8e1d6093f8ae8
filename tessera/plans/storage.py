"""Tables and recordings written and read back: CSV, keyed upserts, order, listings, frames; and operators on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import table_functions
from ..functions.kernels import gaussian_weights, smooth_numpy
from ..operators import asof, chunks, detect, envelopes, fields, ranks
from ..sources import frames, parameters, tables
from ..sources.tables import scratch, table
from ..streaming import live, stateful
from .registry import EV, days, events, hours, query, r6, values_sql

# --- result tables ---------------------------------------------------------------------------------


@query(f"""WITH {EV} SELECT user_id, event_type, count(*) AS n, round(avg(value) + 1e-8, 5) AS mean, CASE WHEN count(*) > 2 THEN event_type || ', "' || user_id END AS note, round(stddev_samp(value) + 1e-8, 5) AS sd FROM ev GROUP BY user_id, event_type""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table through CSV: quoted commas and quotes, NULL numbers and texts."""
    ev = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value") + 1e-8, 5).alias("mean"), F.round(F.stddev_samp("value") + 1e-8, 5).alias("sd"))
    made = ev.select("user_id", "event_type", "n", "mean", F.when(F.col("n") > 2, F.concat("event_type", F.lit(', "'), F.col("user_id").cast("string"))).alias("note"), "sd")
    path = scratch(spark, "csv")
    tables.write_csv(made, path, ["user_id", "event_type"])
    return tables.read_csv(spark, path, "user_id long, event_type string, n long, mean double, note string, sd double")


def upsert_sql(keys: str) -> str:
    """Counts of the first 20 days, replaced by those of the later days where a key has any; keys whose newest event is a signup are cleared."""
    same = " AND ".join(f"o.{k} = x.{k}" for k in keys.split(", "))
    return f"""WITH {EV}, old AS (SELECT {keys}, count(*) AS n, min(value) AS low FROM ev WHERE day < 20 GROUP BY ALL), new AS (SELECT {keys}, count(*) AS n, max(value) AS high FROM ev WHERE day >= 20 GROUP BY ALL),
gone AS (SELECT {keys} FROM ev GROUP BY ALL HAVING arg_max(event_type, (us, event_id)) = 'signup' UNION SELECT {keys} FROM new)
SELECT {keys}, n, round(low, 6) AS low, NULL::DOUBLE AS high FROM old o WHERE NOT EXISTS (SELECT 1 FROM gone x WHERE {same}) UNION ALL SELECT {keys}, n, NULL, round(high, 6) FROM new"""


def upserted_by(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    """The sink itself: two versions of a table, the second made from the first."""
    ev = events(spark, sf_dir)
    old = ev.where("day < 20").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), r6(F.min("value"), "low"))
    new = ev.where("day >= 20").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), r6(F.max("value"), "high"))
    cleared = ev.groupBy(*keys).agg(F.max_by("event_type", F.struct("us", "event_id")).alias("last")).where("last = 'signup'")
    path = scratch(spark, "upsert")
    tables.write_upsert(spark, path, old, keys, sort=keys)
    return tables.write_upsert(spark, path, new, keys, cleared, sort=keys).select(*keys, "n", "low", "high")


@query(upsert_sql("user_id, day"))
def upsert_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserted_by(spark, sf_dir, ["user_id", "day"])


@query(upsert_sql("user_id, event_type, bin"))
def upsert_three_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserted_by(spark, sf_dir, ["user_id", "event_type", "bin"])


@query(f"""WITH {EV}, g AS (SELECT event_type, bin, count(*) AS n FROM ev GROUP BY ALL) SELECT row_number() OVER (ORDER BY n DESC, event_type, bin) AS place, event_type, bin, n FROM g""")
def sorted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places as a sorted table has them on disk: by its files, and the rows in them."""
    g = events(spark, sf_dir).groupBy("event_type", "bin").agg(F.count(F.lit(1)).alias("n"))
    path = scratch(spark, "sorted")
    g.orderBy(F.desc("n"), "event_type", "bin").write.parquet(path)
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(before, "_file").select((F.col("_before") + F.col("_row") + 1).alias("place"), "event_type", "bin", "n")


@query(f"""WITH {EV} SELECT event_type AS session, count(*) AS n_events FROM ev GROUP BY event_type""")
def list_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each kind of event, at two depths; the listing finds them, and its paths are read."""
    ev, root = events(spark, sf_dir), scratch(spark, "sessions")
    kinds = [r[0] for r in ev.select("event_type").distinct().orderBy("event_type").collect()]  # a handful of names
    for depth, kind in enumerate(kinds):
        ids = ev.where(F.col("event_type") == kind).select(F.col("event_id").cast("string"))
        ids.write.text(f"{root}/{'deep/' * (depth % 2)}{kind}.mat")
    files = tables.list_recordings(spark, root, "part-*").where("bytes > 0")
    session = F.regexp_extract("path", r"([^/]+)\.mat/", 1)
    counted = spark.read.text(root, recursiveFileLookup=True, pathGlobFilter="part-*").select(F.col("_metadata.file_path").alias("path")).groupBy("path").count()
    return files.select(session.alias("session"), F.regexp_replace("path", "^file:/*", "/").alias("path")).join(counted.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "count"), "path").groupBy("session").agg(F.sum("count").alias("n_events"))


# --- where a result comes from ---------------------------------------------------------------------


@query(f"""WITH {EV} SELECT event_type, count(*) AS n, 'abc123' AS "commit", '{{"low": 0.5, "seed": 3}}' AS params, TRUE AS dated FROM ev GROUP BY event_type""")
def result_with_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table that carries its commit, its parameters and the time of writing through a file."""
    n = events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    made = tables.written(parameters.with_provenance(n, "abc123", {"seed": 3, "low": 0.5}), "with-provenance")
    return made.select("event_type", "n", "commit", "params", (F.col("written_at") <= F.current_timestamp()).alias("dated"))


@query(f"""WITH {EV} SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM ev GROUP BY event_type""")
def sidecar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two results written into one sidecar, one after the other, each under its own keys; read back as a table."""
    ev, path = events(spark, sf_dir), f"{scratch(spark, 'sidecar')}/result.json"
    for name, column in (("n", F.count(F.lit(1))), ("n_users", F.count_distinct("user_id"))):
        rows = ev.groupBy("event_type").agg(column.alias("v")).collect()  # a handful of types
        parameters.merged_sidecar(path, {"types": {r["event_type"]: {name: r["v"]} for r in rows}}, "abc123")
    said = spark.read.schema("types map<string, struct<n: long, n_users: long>>").option("multiLine", True).json(path)
    return said.select(F.explode("types").alias("event_type", "x")).select("event_type", "x.n", "x.n_users")


# --- recordings ------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT s_nationkey AS k, s_suppkey, s_suppkey % 3 AS grp, s_acctbal < 0 AS skip, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS channel FROM supplier), n AS (SELECT k, count(*) AS n FROM s GROUP BY k), g AS (SELECT k, grp, row_number() OVER (PARTITION BY k ORDER BY grp) AS shank FROM (SELECT DISTINCT k, grp FROM s))
SELECT (1000 + k)::DOUBLE AS rate_hz, n::DOUBLE AS n_channels, shank::INT AS shank, (row_number() OVER (PARTITION BY k, grp ORDER BY s_suppkey) - 1)::INT AS pos, channel::INT AS channel, skip FROM s JOIN n USING (k) JOIN g USING (k, grp)""")
def recording_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML descriptions, one for each nation with its suppliers as channels of three shanks, read back as tables; none has a problem."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", (F.col("s_suppkey") % 3).alias("grp"), (F.col("s_acctbal") < 0).cast("int").alias("skip"))
    s = s.withColumn("channel", F.row_number().over(Window.partitionBy("k").orderBy("s_suppkey")) - 1)
    group = s.groupBy("k", "grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("channel", "skip"))), lambda c: F.format_string('<channel skip="%d">%d</channel>', c["skip"], c["channel"])), "").alias("x"), F.count(F.lit(1)).alias("c"))
    each = group.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("grp", "x"))), lambda g: F.concat(F.lit("<group>"), g["x"], F.lit("</group>"))), "").alias("g"), F.sum("c").alias("n"))
    text = F.format_string("<parameters><acquisitionSystem><nBits>16</nBits><nChannels>%d</nChannels></acquisitionSystem><fieldPotentials><lfpSamplingRate>%d</lfpSamplingRate></fieldPotentials><anatomicalDescription><channelGroups>%s</channelGroups></anatomicalDescription></parameters>", "n", F.col("k") + 1000, "g")
    path = scratch(spark, "descriptions")
    each.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)  # a file is a recording
    recordings, channels = frames.read_descriptions(spark, f"{path}/part-*")
    sound = recordings.join(frames.problems(recordings, channels).select("session").distinct(), "session", "left_anti")
    return sound.join(channels, "session").select("rate_hz", "n_channels", "shank", "pos", "channel", "skip")


def hourly_frames(ev: DataFrame) -> DataFrame:
    """i, values: events of six groups of users by hour, as frames of six channels."""
    n = ev.groupBy(F.floor(F.col("us") / 3_600_000_000).alias("i"), (F.col("user_id") % 6).cast("int").alias("c")).agg(F.count(F.lit(1)).cast("smallint").alias("v"))
    row = n.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("m"))
    first = days(ev).agg(F.min("day").cast("long").alias("d0"))
    grid = hours(ev).join(first).select("i", (F.col("i") - F.col("d0") * 24).alias("at"))
    values = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("smallint")))
    return grid.join(row, "i", "left").select(F.col("at").alias("i"), values.alias("values"))


@query(f"""WITH {EV}, n AS (SELECT us // 3600000000 AS i, user_id % 6 AS c, count(*) AS n FROM ev GROUP BY ALL) SELECT h.i - lo.i AS i, k.c, coalesce(n, 0)::SMALLINT::INT AS v FROM hours h CROSS JOIN (SELECT min(i) AS i FROM hours) lo CROSS JOIN (VALUES (5), (2)) k(c) LEFT JOIN n ON n.i = h.i AND n.c = k.c WHERE h.i - lo.i >= 100 AND h.i - lo.i < 500""")
def frames_of_a_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour of six groups as a recording; two channels of a window are read back, the rest never leaves the file."""
    whole = hourly_frames(events(spark, sf_dir))
    path = scratch(spark, "frames")
    frames.write_frames(whole, path, 6)
    read = frames.read_frames(spark, path, n_channels=6, rate_hz=1.0, session="s", channels=[5, 2]).where("i >= 100 and i < 500")
    return read.select("i", F.posexplode("values").alias("k", "v")).select("i", F.when(F.col("k") == 0, 5).otherwise(2).alias("c"), F.col("v").cast("int").alias("v"))


# --- as-of joins, prefixes, peaks ------------------------------------------------------------------

SIDES = "q AS (SELECT event_id, user_id, us FROM ev WHERE event_type = 'error'), r AS (SELECT event_id AS ref_id, user_id, us FROM ev WHERE event_type = 'view')"


def two_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = events(spark, sf_dir).withColumn("t", F.col("us"))
    return ev.where("event_type = 'error'").select("event_id", "user_id", "t"), ev.where("event_type = 'view'").select(F.col("event_id").alias("ref_id"), "user_id", "t")


@query(f"""WITH {EV}, {SIDES}, p AS (SELECT q.*, r.ref_id AS p_id, r.us AS p_us FROM q ASOF LEFT JOIN r ON q.user_id = r.user_id AND q.us >= r.us), n AS (SELECT q.event_id, r.ref_id AS n_id, r.us AS n_us FROM q ASOF LEFT JOIN r ON q.user_id = r.user_id AND q.us <= r.us)
SELECT event_id, user_id, CASE WHEN p_us IS NULL OR n_us - us < us - p_us THEN n_id ELSE p_id END AS ref_id FROM p JOIN n USING (event_id)""")
def nearest_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error's nearest view of the same user, however far."""
    q, r = two_sides(spark, sf_dir)
    return asof.asof(q, r, ["user_id"], values=["ref_id"]).select("event_id", "user_id", "ref_id")


@query(f"""WITH {EV}, {SIDES} SELECT q.event_id, q.user_id, r.ref_id, r.us - q.us AS wait FROM q ASOF LEFT JOIN r ON q.user_id = r.user_id AND q.us <= r.us""")
def forward_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = two_sides(spark, sf_dir)
    return asof.asof(q, r, ["user_id"], values=["ref_id"], direction="forward").select("event_id", "user_id", "ref_id", (F.col("ref_t") - F.col("t")).alias("wait"))


@query(f"""WITH {EV}, {SIDES} SELECT q.event_id, q.user_id, r.ref_id, q.us - r.us AS age FROM q ASOF LEFT JOIN r ON q.user_id = r.user_id AND q.us >= r.us""")
def backward_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = two_sides(spark, sf_dir)
    return asof.asof(q, r, ["user_id"], values=["ref_id"], direction="backward").select("event_id", "user_id", "ref_id", (F.col("t") - F.col("ref_t")).alias("age"))


@query(f"""WITH {EV}, s AS (SELECT user_id, day, min(us) AS a, max(us) AS b FROM ev GROUP BY ALL), c AS (SELECT *, sum(b - a) OVER w AS upto, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY user_id ORDER BY a ROWS UNBOUNDED PRECEDING))
SELECT user_id, day FROM c WHERE upto <= 86400000000 OR k = 1""")
def time_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first active spells that fill a day at most."""
    spells = events(spark, sf_dir).groupBy("user_id", "day").agg(F.min("us").alias("start"), F.max("us").alias("end"))
    return detect.within_budget(spells, ["user_id"], 86_400_000_000).select("user_id", "day")


@query(f"""WITH RECURSIVE {EV}, h AS (SELECT event_type, us // 3600000000 AS i, round(sum(value), 4) AS v FROM ev GROUP BY ALL), k AS (SELECT DISTINCT event_type FROM h),
p AS (SELECT event_type, 0 AS place, []::BIGINT[] AS taken, NULL::BIGINT AS i, NULL::DOUBLE AS v FROM k UNION ALL
SELECT event_type, place + 1, list_append(taken, b.i), b.i, b.v FROM (SELECT p.event_type, p.place, p.taken, arg_max({{'i': h.i, 'v': h.v}}, (h.v, -h.i)) AS b FROM p JOIN h ON h.event_type = p.event_type AND len(list_filter(p.taken, lambda t: abs(t - h.i) < 12)) = 0 WHERE p.place < 5 GROUP BY ALL))
SELECT event_type, place::INT AS "rank", i, v FROM p WHERE place > 0""")
def greedy_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest hours of each kind of event that lie half a day apart; the larger one shuts out its neighbours."""
    h = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("us") / 3_600_000_000).alias("i")).agg(F.round(F.sum("value"), 4).alias("v"))
    return envelopes.largest_peaks(h, ["event_type"], rate_hz=1.0, n=5, refractory_s=12.0)


# --- table functions in SQL ------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {EV}, h AS (SELECT event_type, us // 3600000000 AS i, round(sum(value), 4) AS v FROM ev GROUP BY ALL), k AS (SELECT DISTINCT event_type FROM h),
p AS (SELECT event_type, 0 AS place, []::BIGINT[] AS taken, NULL::BIGINT AS i, NULL::DOUBLE AS v FROM k UNION ALL
SELECT event_type, place + 1, list_append(taken, b.i), b.i, b.v FROM (SELECT p.event_type, p.place, p.taken, arg_max({{'i': h.i, 'v': h.v}}, (h.v, -h.i)) AS b FROM p JOIN h ON h.event_type = p.event_type AND len(list_filter(p.taken, lambda t: abs(t - h.i) < 12)) = 0 WHERE p.place < 5 GROUP BY ALL))
SELECT event_type, place::INT AS "rank", i, v FROM p WHERE place > 0""")
def greedy_peaks_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same peaks by a table function that is called from SQL."""
    table_functions.register(spark)
    h = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("us") / 3_600_000_000).alias("i")).agg(F.round(F.sum("value"), 4).alias("v"))
    return spark.sql("SELECT * FROM largest_peaks(TABLE({hours}), 5, 12.0)", hours=h)


@query(f"""WITH {EV}, iv AS (SELECT event_type, min(t) AS s, max(t) AS e FROM ev GROUP BY event_type, day), u AS (SELECT *, e - s - 72000 AS room FROM iv WHERE e - s >= 72000),
c AS (SELECT *, sum(room) OVER (PARTITION BY event_type ORDER BY s, e) AS upto, sum(room) OVER (PARTITION BY event_type) AS total, count(*) OVER (PARTITION BY event_type) AS usable FROM u),
k AS (SELECT c.*, k.k::INT AS k, (k.k + 0.5) * total / least(60, floor(total / 72000) + usable) AS target FROM c CROSS JOIN range(60) k(k) WHERE k.k < least(60, floor(total / 72000) + usable))
SELECT event_type, k, round(s + target - (upto - room), 5)::DOUBLE AS start, round(s + target - (upto - room) + 72000, 5)::DOUBLE AS "end" FROM k WHERE target >= upto - room AND target < upto""")
def sample_windows_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of twenty hours in the days of each kind of event, by a table function."""
    table_functions.register(spark)
    active = events(spark, sf_dir).groupBy("event_type", "day").agg(F.min("t").alias("start"), F.max("t").alias("end")).drop("day")
    found = spark.sql("SELECT * FROM sample_windows(TABLE({active}), 72000.0, 60)", active=active)
    return found.select("event_type", "k", F.round("start", 5).alias("start"), F.round("end", 5).alias("end"))


# --- rank tests with their p values ----------------------------------------------------------------


@query(f"""WITH {EV}, d AS (SELECT user_id, value AS x, event_type = 'error' AS one FROM ev WHERE event_type IN ('error', 'view')), c AS (SELECT user_id, x, count(*) FILTER (one) AS a, count(*) FILTER (NOT one) AS b FROM d GROUP BY ALL),
g AS (SELECT user_id, abs(sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p) AS gap, sum(a) OVER p AS n1, sum(b) OVER p AS n2 FROM c WINDOW w AS (PARTITION BY user_id ORDER BY x), p AS (PARTITION BY user_id)),
s AS (SELECT user_id, any_value(n1)::BIGINT AS n1, any_value(n2)::BIGINT AS n2, max(gap) AS d FROM g WHERE n1 > 0 AND n2 > 0 GROUP BY user_id), x AS (SELECT *, d * sqrt(n1 * n2 / (n1 + n2)) AS x FROM s)
SELECT user_id, n1, n2, round(d, 6) AS d, round(CASE WHEN x > 0 THEN least(1.0, greatest(0.0, 2 * (SELECT sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * x * x)) FROM range(1, 101) r(k)))) ELSE 1.0 END, 5) AS p FROM x""")
def ks_with_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors against views of each user: largest gap, and its asymptotic p as a sum inside the row."""
    ev = events(spark, sf_dir)
    out = ranks.ks_statistic(ev, ["user_id"], "event_type", "value", "error", "view").where("n1 > 0 and n2 > 0")
    x = F.col("d") * F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    return out.withColumn("p", F.round(ranks.ks_tail(x), 5)).withColumn("d", r6("d"))


@query(f"""WITH {EV}, d AS (SELECT user_id AS grp, bin, value AS x, event_type = 'error' AS one FROM ev WHERE event_type IN ('error', 'view')), n AS (SELECT grp, bin, count(*) FILTER (one) AS n1, count(*) FILTER (NOT one) AS n2 FROM d GROUP BY ALL HAVING count(*) FILTER (one) BETWEEN 1 AND 4 AND count(*) FILTER (NOT one) BETWEEN 1 AND 4),
v AS (SELECT grp, bin, list(x) FILTER (one) AS a, list(x) AS every FROM d JOIN n USING (grp, bin) GROUP BY ALL HAVING count(DISTINCT x) = count(*)),
u AS (SELECT grp, bin, len(a) AS n1, len(every) - len(a) AS n2, list_sum(list_transform(a, lambda y: len(list_filter(every, lambda z: z < y)) - len(list_filter(a, lambda z: z < y))))::DOUBLE AS u FROM v),
m AS (SELECT n AS n, c, list_filter(range(n), lambda k: (c >> k) & 1 = 1) AS pos FROM range(2, 9) s(n), LATERAL (SELECT range AS c FROM range(1 << n)) t),
w AS (SELECT len(pos) AS n1, n - len(pos) AS n2, list_sum(pos) - len(pos) * (len(pos) - 1) / 2 AS u FROM m WHERE len(pos) BETWEEN 1 AND 4 AND n - len(pos) BETWEEN 1 AND 4)
SELECT grp, bin, x.n1, x.n2, x.u, round((SELECT least(1.0, 2.0 * count(*) FILTER (w.u >= greatest(x.u, x.n1 * x.n2 - x.u)) / count(*)) FROM w WHERE w.n1 = x.n1 AND w.n2 = x.n2), 6) AS p FROM u x""")
def exact_mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and views of each user by hour of day: the exact p of small untied samples, against all arrangements."""
    d = events(spark, sf_dir).where("event_type in ('error', 'view')").select(F.col("user_id").alias("grp"), "bin", "value", "event_type")
    size = d.groupBy("grp", "bin").agg(F.countDistinct("value").alias("_k"), F.count(F.lit(1)).alias("_n")).where("_k = _n")
    out = ranks.mann_whitney(d.join(size, ["grp", "bin"], "left_semi"), ["grp", "bin"], "event_type", "value", "error", "view").where("n1 between 1 and 4 and n2 between 1 and 4")
    return out.select("grp", "bin", "n1", "n2", "u", r6(ranks.mann_whitney_p("u", "n1", "n2", "z", F.lit(False)), "p"))


@query(f"""WITH {EV}, n AS (SELECT us // 3600000000 AS i, (user_id % 6)::INT AS c, count(*) AS n FROM ev GROUP BY ALL), lo AS (SELECT min(i) AS i FROM hours)
SELECT k.c, (h.i - lo.i) // 24 AS day, count(*) AS n_frames, sum(coalesce(n.n, 0))::BIGINT AS total FROM hours h CROSS JOIN lo CROSS JOIN (SELECT range::INT AS c FROM range(6)) k LEFT JOIN n ON n.i = h.i AND n.c = k.c GROUP BY ALL""")
def frames_of_a_growing_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over a recording that is appended to: it stops, the recording grows, it goes on from its checkpoint; each frame comes once."""
    whole = hourly_frames(events(spark, sf_dir))
    path, arrived, progress = (scratch(spark, name) for name in ("growing", "arrived", "progress"))
    half = F.col("i") < F.lit(361)
    for part, later in ((whole.where(half), False), (whole.where(~half), True)):
        frames.write_frames(part, path, 6, append=later)
        stream = frames.stream_frames(spark, path, n_channels=6, rate_hz=1.0, session="s").select("i", "values")
        got = live.drained(stream, arrived, progress)
    each = got.select("i", F.posexplode("values").alias("c", "v"))
    return each.groupBy("c", F.floor(F.col("i") / 24).alias("day")).agg(F.count(F.lit(1)).alias("n_frames"), F.sum("v").alias("total"))


# --- one key over all tasks ------------------------------------------------------------------------


@query(f"""WITH {EV}, q AS (SELECT event_id, us FROM ev WHERE event_type = 'purchase'), r AS (SELECT us, min(event_id) AS ref_id FROM ev WHERE event_type = 'error' GROUP BY us),
b AS (SELECT q.*, p.us AS u0, p.ref_id AS r0 FROM q ASOF LEFT JOIN r p ON q.us >= p.us), a AS (SELECT q.event_id, n.us AS u1, n.ref_id AS r1 FROM q ASOF LEFT JOIN r n ON q.us <= n.us)
SELECT event_id, CASE WHEN u1 - us < us - u0 OR u0 IS NULL THEN r1 ELSE r0 END AS ref_id, CASE WHEN u1 - us < us - u0 OR u0 IS NULL THEN u1 - us ELSE us - u0 END AS away_us FROM b JOIN a USING (event_id)""")
def nearest_asof_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest error of each purchase in the whole recording: no key but the recording, dealt out by spans of an hour."""
    ev = events(spark, sf_dir)
    q, r = ev.where("event_type = 'purchase'").select("event_id", "us"), ev.where("event_type = 'error'").select("us", F.col("event_id").alias("ref_id"))
    return asof.asof(q, r, [], t="us", values=["ref_id"], piece=3.6e9).select("event_id", "ref_id", F.abs(F.col("us") - F.col("ref_t")).alias("away_us"))


@query(f"""WITH {EV} SELECT event_id, sum(round(value * 100)::BIGINT) OVER (ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cents FROM ev""")
def running_sum_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running sum over the whole recording, in spans of an hour."""
    rows = events(spark, sf_dir).select("event_id", "us", F.round(F.col("value") * 100).cast("long").alias("c"))
    return chunks.running_sum(rows, "c", [], ["us", "event_id"], 3.6e9, "cents").select("event_id", "cents")


# --- a null over running time ----------------------------------------------------------------------

SHUFFLES = 500


def running_slots(ev: DataFrame, moving: str = "true") -> tuple[DataFrame, DataFrame]:
    """Ten-minute slots with an event that ``moving`` marks, numbered, with their hour of day; and the spikes of forty cells in them."""
    ev = ev.withColumn("slot10", F.floor(F.col("us") / 600_000_000))
    # One row a slot, so that this one window is over the recording's length, not its events
    running = ev.where(moving).select("slot10", "bin").distinct().withColumn("slot", F.row_number().over(Window.orderBy("slot10")) - 1).withColumn("session", F.lit("s"))
    cells = ev.join(running.select("session", "slot10", "slot"), "slot10").groupBy("session", (F.col("user_id") % 40).alias("cell"), "slot").agg(F.count(F.lit(1)).alias("k"))
    return running.select("session", "slot", "bin"), cells


SMOOTH = [(a, b, w) for a in range(24) for b, w in zip(range(a - 4, a + 5), gaussian_weights(1.0), strict=True)]


@query(f"""WITH {EV}, run AS (SELECT slot10, bin, row_number() OVER (ORDER BY slot10) - 1 AS slot FROM (SELECT DISTINCT us // 600000000 AS slot10, bin FROM ev WHERE event_type = 'purchase')), size AS (SELECT count(*) AS n FROM run),
kern AS (SELECT a, (b + 24) % 24 AS b, w FROM {values_sql(SMOOTH, "t(a, b, w)")}), raw AS (SELECT b.bin, 600 * count(slot) AS o FROM range(24) b(bin) LEFT JOIN run USING (bin) GROUP BY b.bin), occ AS (SELECT b AS bin, any_value(r2.o) AS o, sum(raw.o * w) AS so FROM raw JOIN kern ON raw.bin = a JOIN raw r2 ON r2.bin = b GROUP BY b),
c AS (SELECT user_id % 40 AS cell, slot, count(*) AS k FROM ev JOIN run ON run.slot10 = us // 600000000 GROUP BY ALL), cells AS (SELECT DISTINCT cell FROM c),
sh AS (SELECT cell, k AS shuffle_id, CASE WHEN k = 0 THEN 0 ELSE 1 + ('0x' || substr(md5('0:' || cell || ':' || k), 1, 12))::BIGINT % (n - 2) END AS shift FROM range({SHUFFLES + 1}) t(k), size, cells),
m AS (SELECT cell, shuffle_id, run.bin, sum(k) AS n FROM c JOIN sh USING (cell) CROSS JOIN size JOIN run ON run.slot = (c.slot + shift) % size.n GROUP BY ALL),
r AS (SELECT cell, shuffle_id, b AS bin, sum(m.n * w) / any_value(so) AS r, any_value(o) AS o FROM m JOIN kern ON m.bin = a JOIN occ ON occ.bin = b WHERE o >= 40000 GROUP BY cell, shuffle_id, b),
v AS (SELECT *, o / (SELECT sum(o) FROM occ WHERE o >= 40000) AS q, sum(r * o) OVER (PARTITION BY cell, shuffle_id) / (SELECT sum(o) FROM occ WHERE o >= 40000) AS mean FROM r),
i AS (SELECT cell, shuffle_id, round(sum(CASE WHEN r > 0 THEN q * r / mean * log2(r / mean) ELSE 0 END), 7) AS info FROM v GROUP BY ALL),
z AS (SELECT a.cell, a.info, round(avg(b.info), 6) AS null_mean, round((a.info - avg(b.info)) / stddev_pop(b.info), 4) AS info_z, round((1 + count(*) FILTER (b.info >= a.info)) / {SHUFFLES + 1}.0, 6) AS p FROM i a JOIN i b ON a.cell = b.cell AND a.shuffle_id = 0 AND b.shuffle_id > 0 GROUP BY a.cell, a.info)
SELECT cell, info, null_mean, info_z, p FROM cells LEFT JOIN z USING (cell)""")
def running_time_null_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same null as place cells are tested by: smoothed rates, no rate in hours seldom visited, shifts seeded by cell. Slots with a purchase are the running ones."""
    running, cells = running_slots(events(spark, sf_dir), "event_type = 'purchase'")
    out = fields.shift_null(cells, running, ["cell"], fields.seeded_shifts(SHUFFLES), n_bins=24, slot_s=600.0, sigma=1.0, min_occupancy=40_000.0)
    return out.select("cell", "info", r6("null_mean", "null_mean"), F.round("info_z", 4).alias("info_z"), r6("p", "p"))


@query(f"""WITH {EV}, run AS (SELECT slot10, bin, row_number() OVER (ORDER BY slot10) - 1 AS slot FROM (SELECT DISTINCT us // 600000000 AS slot10, bin FROM ev)), size AS (SELECT count(*) AS n FROM run),
occ AS (SELECT bin, count(*) AS o FROM run GROUP BY bin), sp AS (SELECT user_id % 40 AS cell, slot FROM ev JOIN run ON run.slot10 = us // 600000000), c AS (SELECT cell, slot, count(*) AS k FROM sp GROUP BY ALL),
sh AS (SELECT k AS shuffle_id, CASE WHEN k = 0 THEN 0 ELSE (k * 7919) % n END AS shift FROM range({SHUFFLES + 1}) t(k), size), m AS (SELECT cell, shuffle_id, run.bin, sum(k) AS n FROM c CROSS JOIN sh CROSS JOIN size JOIN run ON run.slot = (c.slot + shift) % size.n GROUP BY ALL),
i AS (SELECT cell, shuffle_id, round(sum(m.n / t.n * log2((m.n / occ.o) / (t.n / size.n))), 7) AS info FROM m JOIN occ USING (bin) JOIN (SELECT cell, sum(k) AS n FROM c GROUP BY cell) t USING (cell) CROSS JOIN size GROUP BY ALL)
SELECT a.cell, a.info AS observed, count(*) FILTER (b.info >= a.info) AS n_at_least, round((1 + count(*) FILTER (b.info >= a.info)) / {SHUFFLES + 1}.0, 6) AS p FROM i a JOIN i b ON a.cell = b.cell AND a.shuffle_id = 0 AND b.shuffle_id > 0 GROUP BY a.cell, a.info""")
def running_time_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information about the hour against 500 circular shifts through compressed running time (ten-minute slots with any event)."""
    running, cells = running_slots(events(spark, sf_dir))
    out = fields.shift_null(cells, running, ["cell"], fields.multiple_shifts(SHUFFLES, 7919), n_bins=24)
    return out.select("cell", F.col("info").alias("observed"), "n_at_least", r6("p", "p"))


# --- streams: the batch result, from rows that arrive one micro-batch after the other ---------------


def event_stream(spark: SparkSession, sf_dir: str, parts: int = 4, most: int = 500_000) -> DataFrame:
    """The events as a stream of spans of time that arrive one after the other, one span a micro-batch.

    A span has as many files as the smallest one needs for ``most`` rows a file: so each batch takes just one span's files.
    """
    path, rows = scratch(spark, "arrivals"), table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    ends = rows.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi"))
    dealt = rows.crossJoin(F.broadcast(ends)).withColumn("part", F.floor((F.unix_micros("ts") - F.col("lo")) * parts / (F.col("hi") - F.col("lo") + 1)))
    found = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}  # a row a span
    files = max(1, min(found.get(k, 0) for k in range(parts)) // most)
    for k in range(parts):  # one after the other: files arrive in the order of their spans
        dealt.where(F.col("part") == k).select(*rows.columns).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def arrivals(spark: SparkSession, rows: DataFrame, ts: str, closing: DataFrame, parts: int = 4) -> DataFrame:
    """Rows as a stream of ``parts`` spans of time, each of several files in any order, and last a row far ahead that moves the watermark past all."""
    path = scratch(spark, "arrivals")
    at = F.unix_micros(ts)
    ends = rows.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    dealt = rows.join(ends).withColumn("part", F.floor((at - F.col("lo")) * parts / (F.col("hi") - F.col("lo") + 1)))
    for k in range(parts):
        dealt.where(F.col("part") == k).select(*rows.columns).repartition(4).write.mode("append").parquet(path)
    closing.select(*rows.columns).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)


def run_stream(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    return live.drained(stream, scratch(spark, "arrived"), scratch(spark, "progress"), mode=mode)


@query(f"""WITH {EV} SELECT event_type, (us // 21600000000) * 21600 AS start_s, count(*) AS n FROM ev GROUP BY ALL""")
def stream_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = run_stream(spark, live.binned_counts(event_stream(spark, sf_dir), "6 hours", ["event_type"]), "complete")
    return counts.select("event_type", (F.unix_seconds("start") - 1_704_067_200).alias("start_s"), "n")


@query(f"""WITH {EV} SELECT event_type, (us // 21600000000 - k) * 21600 AS start_s, count(*) AS n FROM ev CROSS JOIN range(2) t(k) GROUP BY ALL""")
def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of twelve hours, one every six."""
    counts = run_stream(spark, live.binned_counts(event_stream(spark, sf_dir), "12 hours", ["event_type"], slide="6 hours"), "complete")
    return counts.select("event_type", (F.unix_seconds("start") - 1_704_067_200).alias("start_s"), "n")


@query(f"""WITH {EV}, s AS (SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS burst FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) < 14400000000 THEN 0 ELSE 1 END AS new FROM ev))
SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM s GROUP BY user_id, burst HAVING count(*) >= 2""")
def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_stream(spark, live.bursts(event_stream(spark, sf_dir), "4 hours", ["user_id"]), "complete")
    us = lambda c: F.unix_micros(c) - 1_704_067_200_000_000
    return found.select("user_id", us(F.col("start")).alias("start_us"), us(F.col("end")).alias("end_us"), "n")


@query(f"""WITH {EV}, v AS (SELECT user_id, us, event_id, value - 50 AS x FROM ev) SELECT user_id, us, coalesce(last_value(CASE WHEN x > 25 THEN 1 WHEN x < -25 THEN -1 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), 0) AS latch, FALSE AS late FROM v""")
def stream_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latch's state goes from one micro-batch to the next."""
    rows = event_stream(spark, sf_dir).select("user_id", "ts", "event_id", (F.col("value") - 50).alias("x"))
    out = run_stream(spark, live.latched(rows, "x", 25.0, "user_id", then="event_id"), "append")
    return out.select("user_id", (F.unix_micros("ts") - 1_704_067_200_000_000).alias("us"), "latch", "late")


TENS = """tr AS (SELECT t.event_type, h.i * 6 + k.k AS i, coalesce(n.n, 0)::DOUBLE AS v FROM hours h CROSS JOIN (SELECT range AS k FROM range(6)) k CROSS JOIN (SELECT DISTINCT event_type FROM ev) t LEFT JOIN (SELECT event_type, us // 600000000 AS i, count(*) AS n FROM ev GROUP BY ALL) n ON n.event_type = t.event_type AND n.i = h.i * 6 + k.k)"""


def ten_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, i, t, v, ts: events of each type by ten minutes, the empty ones too."""
    ev = events(spark, sf_dir)
    n = ev.groupBy("event_type", F.floor(F.col("us") / 600_000_000).alias("i")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    grid = hours(ev).select(F.explode(F.sequence(F.col("i") * 6, F.col("i") * 6 + 5)).alias("i")).crossJoin(ev.select("event_type").distinct())
    return grid.join(n, ["event_type", "i"], "left").select("event_type", "i", (F.col("i") * 600.0).alias("t"), F.coalesce("v", F.lit(0.0)).alias("v"), F.timestamp_seconds(F.col("i") * 600).alias("ts"))


def ten_minute_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream; the type ``~`` closes it."""
    rows = ten_minutes(spark, sf_dir)
    last = rows.agg(F.max("i").alias("i")).select(F.lit("~").alias("event_type"), "i", F.lit(0.0).alias("t"), F.lit(0.0).alias("v"), F.timestamp_seconds(F.col("i") * 600 + 366 * 86_400).alias("ts"))
    return arrivals(spark, rows, "ts", last)


@query(f"""WITH {EV}, {TENS}, b AS (SELECT event_type, round(avg(v), 6) AS lo, round(avg(v) + 1.5 * stddev_pop(v), 6) AS hi FROM tr GROUP BY event_type), f AS (SELECT tr.*, v >= lo AND v > 0 AS low, v >= hi AS high FROM tr JOIN b USING (event_type)),
r AS (SELECT event_type, min(i) AS a, max(i) AS z FROM (SELECT *, i - row_number() OVER (PARTITION BY event_type ORDER BY i) AS island FROM f WHERE low) GROUP BY event_type, island HAVING bool_or(high)),
m AS (SELECT event_type, min(a) AS first, max(z) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY a) AS e FROM (SELECT *, CASE WHEN a - lag(z) OVER (PARTITION BY event_type ORDER BY a) < 3 THEN 0 ELSE 1 END AS new FROM r)) GROUP BY event_type, e)
SELECT m.event_type, first * 600.0::DOUBLE AS start, arg_max(t.i, (t.v, -t.i)) * 600.0::DOUBLE AS peak, (last + 1) * 600.0::DOUBLE AS "end", max(t.v) AS peak_value FROM m JOIN tr t ON t.event_type = m.event_type AND t.i BETWEEN first AND last WHERE last - first + 1 BETWEEN 2 AND 24 GROUP BY ALL""")
def stream_two_threshold_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-threshold events on a stream: open run, candidate, merge and duration rule live in state; timers end what nothing can change any more."""
    stream = ten_minute_stream(spark, sf_dir)
    base = ten_minutes(spark, sf_dir).groupBy("event_type").agg(F.round(F.avg("v"), 6).alias("lo"), F.round(F.avg("v") + 1.5 * F.stddev_pop("v"), 6).alias("hi"))
    rows = stream.join(base, "event_type", "left")
    found = stateful.two_threshold_events(rows, "event_type", low=F.greatest(F.col("lo"), F.lit(1e-9)), high=F.col("hi"), merge_gap=1800.0, min_duration=1200.0, max_duration=4 * 3600.0, dt=600.0, idle=86_400.0, late="10 days")
    return run_stream(spark, found, "append")


@query(f"""WITH {EV}, {TENS}, kern AS (SELECT * FROM {values_sql([(k - 8, w) for k, w in enumerate(gaussian_weights(2.0))], "t(k, w)")}), ends AS (SELECT min(i) AS lo, max(i) AS hi FROM tr)
SELECT a.event_type, a.i, a.v, round(sum(b.v * w), 6) AS filtered FROM tr a CROSS JOIN ends CROSS JOIN kern JOIN tr b ON b.event_type = a.event_type AND b.i = least(greatest(a.i + k, lo), hi) GROUP BY a.event_type, a.i, a.v""")
def stream_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothing on a stream to its very end: the last samples of a key leave once it is idle."""
    rows = ten_minute_stream(spark, sf_dir)
    out = run_stream(spark, stateful.filtered(rows, "event_type", lambda x: smooth_numpy(x, 2.0), 16, idle=86_400.0, late="10 days"), "append").where("event_type <> '~'")
    return out.select("event_type", "i", "v", r6("filtered", "filtered"))
