"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import re
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def trim() -> None:
    """What is free goes back to the system: the C library would keep it as long as the process runs, and workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (back := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        back(0)


def hands_memory_back(train: Callable) -> Callable:
    """What a fit has freed goes back to the system when it ends: the C library would keep it as long as the driver runs."""

    @functools.wraps(train)
    def run(*args, **settings):
        try:
            return train(*args, **settings)
        finally:
            trim()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir``.

    Only a local master may go without: a temporary folder is set then. RuntimeError on a cluster, where
    every executor would write to its own disk.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        there = tempfile.mkdtemp(prefix="tessera-shared-")
        atexit.register(shutil.rmtree, there, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", there)
    return there


_written: dict[int, tuple[DataFrame, str]] = {}  # tables that ``release`` may delete, by the identity of their DataFrame


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts the lineage: a lost executor costs the tasks it ran, never the steps before. All tables of an
    application lie in one folder, ``tessera/<application id>``, which may go when it has ended; those that
    only led to others go before that, by ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    _written[id(made)] = (made, path)
    return made


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` returned and that nothing reads any more."""
    for df in tables:
        known = _written.pop(id(df), None)
        if known and known[0] is df:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(known[1])
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2,000 rows and 8 MB from here on: texts are long, and workers are many.

    Spark's defaults (10,000 rows, 64 MB) cost each task several times that outside the heap. Smaller
    settings of the session stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2_000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        found = re.match(r"-?\d+", spark.conf.get(key, None) or "")
        if not found or not 0 < int(found[0]) <= most:
            spark.conf.set(key, str(most))


def id_crc(column: str) -> Column:
    """Unsigned crc32 of an id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def hash_share(id_column: str | list[str], rows: int, bound: int) -> Column:
    """True for about ``bound`` of ``rows`` rows, chosen by a hash of the id (or of several columns): the same in each run."""
    share = 1.0 if rows <= bound else bound / rows
    return F.pmod(F.xxhash64(*([id_column] if isinstance(id_column, str) else id_column)), F.lit(1 << 30)) < int(share * (1 << 30))


def bounded(rows: DataFrame, key: list[str], size: Column, most_rows: int, most_bytes: int) -> DataFrame:
    """At most ``most_rows`` of ``rows`` with at most ``most_bytes`` in all, those with the smallest hash of ``key``: the same in each run.

    Each task keeps its own smallest ones first. Rows equal in ``key`` that cross the bound in bytes go together.
    """
    (by,) = fresh(rows, "_by")
    kept = materialize(rows.withColumn(by, F.xxhash64(*key)).orderBy(by, *key).limit(most_rows), "sample")
    upto = Window.orderBy(by)  # of at most most_rows narrow rows; equal hashes share one sum
    over = kept.select(by, size.cast("long").alias("_size")).select(by, F.sum("_size").over(upto).alias("_upto")).where(F.col("_upto") > most_bytes).agg(F.min(by)).first()[0]
    return (kept if over is None else kept.where(F.col(by) < over)).drop(by)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to write under these names."""
    return df.drop(*names)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A driver's list as a DataFrame; a join may broadcast it only if it has 10,000 rows at most."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= 10_000 else df


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most_bytes`` of text (one row at least). What the worker's last task left free goes back first."""
    trim()
    for batch in batches:
        if not batch.num_rows:
            continue
        n = max(1, min(batch.num_rows, batch.num_rows * most_bytes // max(1, batch.column(text).nbytes)))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


class Cache(dict):
    """A memo bounded in entries and in bytes: ``make(key)`` on a miss; it is emptied once it is full.

    Bytes are those of keys and values and a dict's own share of an entry. What alone would take a
    sixteenth of them, such as one unbroken run of a long text, is made each time and never held.
    """

    ENTRY = 60

    def __init__(self, make, most: int, most_bytes: int = 16 << 20):
        super().__init__()
        self.make, self.most, self.most_bytes, self.held = make, most, most_bytes, 0

    def __del__(self):
        """A memo ends with its task; idle workers should not hold on to its memory."""
        if self.held > 1 << 20 and not sys.is_finalizing():
            self.clear()
            trim()

    def __missing__(self, key):
        value = self.make(key)
        size = self.ENTRY + sys.getsizeof(key) + sys.getsizeof(value)
        if size > self.most_bytes >> 4:
            return value
        if len(self) >= self.most or self.held + size > self.most_bytes:
            self.clear()
            self.held = 0
        self[key] = value
        self.held += size
        return value


def numbered(df: DataFrame, group: str, order: list[Column], *, place: str, count: str) -> DataFrame:
    """``df`` with each row's place in its group (from 0) in this order, and the group's size, as longs.

    Rows are dealt out by ranges of (group, order) and numbered within their piece; the places of a piece
    follow from the sizes of those before it, one row for each piece and group. No group, however large, is
    sorted in one task. ``group`` must not be null; rows that tie in the order get places in any order.
    """
    row, piece, first, before = fresh(df, "_row", "_piece", "_first", "_before")
    dealt = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    rows = materialize(dealt.withColumn(row, F.monotonically_increasing_id()), "numbered").withColumn(piece, F.shiftright(row, 33))
    pieces = rows.groupBy(group, piece).agg(F.min(row).alias(first), F.count(F.lit(1)).alias(count))
    of = Window.partitionBy(group)
    upto = of.orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(group, piece, first, F.coalesce(F.sum(count).over(upto), F.lit(0).cast("long")).alias(before), F.sum(count).over(of).alias(count))
    pieces = materialize(pieces, "pieces")  # small, and Spark sees its size: rows are not shuffled again for it
    return rows.join(pieces, [group, piece]).withColumn(place, F.col(before) + F.col(row) - F.col(first)).drop(row, piece, first, before)
