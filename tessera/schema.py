"""Record types of a recording, and the checks that ingest makes.

All times are DOUBLE seconds on the session clock. NaN never leaves ingest: Spark orders NaN above every
number and calls it equal to itself, so undefined samples are NULL from here on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SESSIONS = "session string, animal string, maze_type string, maze_kind string, track_length_m double, sess_duration double"
SPIKES = "session string, cluster_id bigint, t double"
UNITS = "session string, cluster_id bigint, kind string, shank int"
POSITION = "session string, sample bigint, t double, x double, y double, x1d double"
EPOCHS = "session string, epoch string, start double, end double"
STATES = "session string, state string, start double, end double"
CHANNELS = "session string, shank int, channel int, skip boolean"
FRAMES = "session string, i bigint, values array<smallint>"


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN and infinities become NULL in the given columns, by default in all floating ones."""
    columns = columns or tuple(c for c, t in df.dtypes if t in ("double", "float"))
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in columns})


def whole_ids(column: Column) -> Column:
    """DOUBLE ids to BIGINT; an error for any that isn't a finite whole number."""
    fine = ~F.isnan(column) & (F.abs(column) < float("inf")) & (column == F.floor(column))
    return F.when(column.isNull() | fine, column.cast("bigint")).otherwise(F.raise_error(F.lit("an id is not a whole number")).cast("bigint"))


def shank_of(cluster_id: Column, divisor: int = 100) -> Column:
    return F.floor(cluster_id / divisor).cast("int")


def animal_of(session: Column) -> Column:
    """``Animal_MMDDYYYY`` gives the animal; any other name is an error."""
    animal = F.regexp_extract(session, r"^([A-Za-z]+)_(\d{8})$", 1)
    return F.when(animal != "", animal).otherwise(F.raise_error(F.concat(F.lit("not a session name: "), session)))


def maze_kind(maze_type: Column) -> Column:
    low = F.lower(maze_type)
    return F.when(low.contains("linear"), "linear").when(low.contains("circular") | low.contains("circle"), "circular").otherwise(F.raise_error(F.concat(F.lit("unknown maze: "), maze_type)))


def track_length_m(maze_type: Column) -> Column:
    """``1.6m Linear Maze`` gives 1.6; NULL where no length is named."""
    said = F.regexp_extract(maze_type, r"(\d+(?:\.\d+)?)\s*m\b", 1)
    return F.when(said != "", said.cast("double"))


def spike_counts(spikes: DataFrame, units: DataFrame) -> DataFrame:
    """session, cluster_id, kind, shank, n_spikes; labelled clusters without spikes have 0."""
    counts = spikes.groupBy("session", "cluster_id").agg(F.count(F.lit(1)).alias("n_spikes"))
    return units.join(counts, ["session", "cluster_id"], "left").withColumn("n_spikes", F.coalesce("n_spikes", F.lit(0)))


def position_dt(position: DataFrame) -> DataFrame:
    """session, dt: the median step between samples."""
    from pyspark.sql import Window

    step = F.col("t") - F.lag("t").over(Window.partitionBy("session").orderBy("t"))
    return position.select("session", step.alias("step")).groupBy("session").agg(F.percentile("step", 0.5).alias("dt"))
