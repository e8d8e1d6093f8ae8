"""Result tables: keyed upsert, rounding, and the driver's tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def upserted(old: DataFrame | None, new: DataFrame, keys: list[str], cleared: DataFrame | None = None) -> DataFrame:
    """Old rows whose key is neither in ``new`` nor in ``cleared``, and all new rows; columns of both.

    ``cleared`` (rows of keys) also empties keys for which nothing new was made. A table that lacks a key
    column is replaced as a whole.
    """
    if old is None or any(k not in old.columns for k in keys):
        return new
    gone = new.select(*keys) if cleared is None else cleared.select(*keys).unionByName(new.select(*keys))
    return old.join(gone.distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions of a table, in order: a version counts once Spark has marked it as written."""
    store, at = _store(spark, path)
    if not store.exists(at):
        return []
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = (x.getPath() for x in store.listStatus(at) if x.isDirectory() and x.getPath().getName().startswith("version-"))
    return sorted(int(v.getName().removeprefix("version-")) for v in found if store.exists(new(v, "_SUCCESS")))


def read_versioned(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version of a table; None if there is none."""
    known = versions(spark, path)
    return spark.read.parquet(f"{path.rstrip('/')}/version-{known[-1]:08d}") if known else None


def write_upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], cleared: DataFrame | None = None, sort: list[str] | None = None) -> DataFrame:
    """Upsert into a versioned Parquet table (one writer at a time).

    The next version is a folder beside the others and counts once it is marked as whole, so a crash at any
    moment leaves the newest whole one to readers, and nothing is renamed. The version before stays for those
    who read it just now; older ones and what crashes left go.
    """
    made = upserted(read_versioned(spark, path), new, keys, cleared)
    if sort:
        made = made.repartitionByRange(*sort).sortWithinPartitions(*sort)
    known = versions(spark, path)
    number = known[-1] + 1 if known else 0
    made.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version-{number:08d}")
    store, at = _store(spark, path)
    for x in store.listStatus(at):
        if x.isDirectory() and x.getPath().getName().startswith("version-") and int(x.getPath().getName().removeprefix("version-")) < number - 1:
            store.delete(x.getPath(), True)
    return read_versioned(spark, path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); a temporary one for a local master that names none."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        there = tempfile.mkdtemp(prefix="tessera-tables-")
        atexit.register(shutil.rmtree, there, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", there)
    return f"{there.rstrip('/')}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: it cuts the lineage, and Spark knows its size. All go with the application's folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str, sort: list[str]) -> None:
    """Result table as CSV with a header, in order over all its files; NULL is an empty field, an empty text is quoted."""
    df.repartitionByRange(*sort).sortWithinPartitions(*sort).write.option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result table with exactly these columns in this order; a field of another type, or too many or too few, fails the read."""
    quoted = "\x01"  # what stands for a quoted empty text while it is read, as Spark takes any empty text as NULL
    rows = spark.read.schema(schema).options(header=True, enforceSchema=False, mode="FAILFAST", emptyValue=quoted).csv(path)
    return rows.withColumns({c: F.when(F.col(c) == quoted, "").otherwise(F.col(c)) for c, kind in rows.dtypes if kind == "string"})


def list_recordings(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """session, path, bytes, modified of all files of a pattern at any depth; a session is the file's name up to the first dot. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_replace(name, r"\..*$", "").alias("session"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def write_by_key(df: DataFrame, path: str, key: str) -> None:
    """Replace only the partitions of the keys that ``df`` has; nothing else is read or written."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def significant(column: Column, figures: int = 3) -> Column:
    """Rounded to so many significant figures; NULL and NaN pass."""
    made = F.format_string(f"%.{figures - 1}e", column).cast("double")
    return F.when(column.isNull() | F.isnan(column) | (column == 0), column).otherwise(made)


def rounded(df: DataFrame, decimals: int = 5, figures: int = 3, significant_columns: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded half to even, and the named ones (p values) to significant figures, so that a small p never reads 0."""
    return df.withColumns({c: significant(F.col(c), figures) if c in significant_columns else F.bround(c, decimals) for c, t in df.dtypes if t in ("double", "float")})


def union_widened(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
