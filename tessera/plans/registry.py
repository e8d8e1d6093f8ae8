"""The list of queries. A query registers itself with the SQL that gives the same rows, where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


DAY_US, HOUR_US = 86_400_000_000, 3_600_000_000
US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a recording: us (microseconds since 2024-01-01), t (seconds), day (lap), bin (hour of day, a ring of 24)."""
    rows = table(spark, sf_dir, "events").withColumn("us", F.expr(US))
    day = F.floor(F.col("us") / DAY_US).cast("int")
    return rows.select("event_id", "user_id", "event_type", "value", "us", (F.col("us") / 1e6).alias("t"), day.alias("day"), F.floor((F.col("us") - day.cast("long") * DAY_US) / HOUR_US).cast("int").alias("bin"))


def days(ev: DataFrame) -> DataFrame:
    """day, n_days: every day from the first to the last one that has an event, with or without events of its own."""
    ends = ev.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("lo is not null")
    return ends.select(F.explode(F.sequence("lo", "hi")).alias("day"), (F.col("hi") - F.col("lo") + 1).cast("long").alias("n_days"))


def hours(ev: DataFrame) -> DataFrame:
    """day, bin, i (hours since 2024-01-01), n_days."""
    each = days(ev).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return each.withColumn("i", F.col("day").cast("long") * 24 + F.col("bin"))


#: The same for the oracle.
EV = """ev AS (SELECT event_id, user_id, event_type, value, us, us / 1e6 AS t, (us // 86400000000)::INT AS day, ((us % 86400000000) // 3600000000)::INT AS bin
FROM (SELECT *, epoch_us(ts) - 1704067200000000 AS us FROM events)),
days AS (SELECT unnest(generate_series(lo, hi))::INT AS day FROM (SELECT min(day) AS lo, max(day) AS hi FROM ev)), hours AS (SELECT day, range::INT AS bin, day::BIGINT * 24 + range AS i FROM days CROSS JOIN range(24))"""


def epoch_of(day: str = "day"):
    return F.when(F.col(day) < 10, "PRE").when(F.col(day) < 20, "MAZE").otherwise("POST")


EPOCH = "CASE WHEN day < 10 THEN 'PRE' WHEN day < 20 THEN 'MAZE' ELSE 'POST' END"


def r6(column, name: str | None = None):
    out = F.round(column, 6)
    return out.alias(name) if name else out


def values_sql(rows: list[tuple], names: str) -> str:
    """A literal table in SQL, doubles with all their digits."""
    shown = ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" if isinstance(v, float) else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(VALUES {shown}) AS {names}"
