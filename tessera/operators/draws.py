"""Random numbers that don't depend on how rows are dealt out.

Either each number is the MD5 of a seed, a key and a place, which any engine can make again; or one sequential
generator is dealt out: each key's place in its stream is the sum of what the keys before it draw, and the generator is
advanced to it, so that all tasks together draw what one loop over the keys would.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def hashed(seed: int, *parts: Column | str) -> Column:
    """MD5 of ``seed:part:...`` as text; NULL parts are empty. Rows in its order are in random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts)).cast("binary"))


def hashed_numbers(seed: int, key: object, shape: tuple[int, int]) -> np.ndarray:
    """48-bit numbers: those of ``seed:key:row:column``."""
    begin = hashlib.md5(f"{seed}:{key}:".encode())
    out = np.empty(shape, np.int64)
    for row in range(shape[0]):
        for column in range(shape[1]):
            h = begin.copy()
            h.update(f"{row}:{column}".encode())
            out[row, column] = int(h.hexdigest()[:12], 16)
    return out


def stream_numbers(seed: int, place: int, shape: tuple[int, int]) -> np.ndarray:
    """48-bit numbers from ``place`` on of the one stream of a seed."""
    bits = np.random.PCG64(seed)
    bits.advance(place)
    return (bits.random_raw(shape[0] * shape[1]) >> np.uint64(16)).astype(np.int64).reshape(shape)


def placed(df: DataFrame, order: list[str], count: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``count`` over all rows before each in the order of these columns, which tell rows apart.

    Rows are dealt out by ranges of the order; each range is summed by itself, and one row a range carries the sum on.
    """
    rows = df.withColumn("_n", count.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "placed").withColumn("_piece", F.shiftright("_row", 33))
    totals = rows.groupBy("_piece").agg(F.sum("_n").alias("_total"))
    upto = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    carried = written(totals.select("_piece", F.coalesce(F.sum("_total").over(upto), F.lit(0).cast("long")).alias("_carried")), "carried")
    inside = Window.partitionBy("_piece").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("_own", F.coalesce(F.sum("_n").over(inside), F.lit(0).cast("long"))).join(carried, "_piece")
    return own.select(*df.columns, (F.col("_own") + F.col("_carried")).alias(out))
