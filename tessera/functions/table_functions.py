"""Table functions for SQL: ``SELECT * FROM sample_windows(TABLE(SELECT session, start, end FROM ...), 600.0, 5)``.

Each takes a table and says itself, from the table's columns, how its rows are to be partitioned and ordered and what it
returns: all columns that it does not use are keys, and every key's rows are one call's.
"""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SkipRestOfInputTableException


class FormError(ValueError):
    """A call with other arguments than the function takes."""


def _result(table: AnalyzeArgument, used: dict[str, str], numbers: dict[str, AnalyzeArgument], out: list[T.StructField], order: list[OrderingColumn]) -> AnalyzeResult:
    """The schema, keys first, with partitions by the keys; FormError for anything that can't be."""
    if not table.isTable:
        raise FormError("the first argument is TABLE(...)")
    kinds = {f.name: f.dataType for f in table.dataType.fields}
    for name, kind in used.items():
        if name not in kinds or not isinstance(kinds[name], T.NumericType):
            raise FormError(f"the table has a numeric column {name} ({kind})")
    for name, given in numbers.items():
        if given.isTable or not isinstance(given.dataType, T.NumericType) or (given.value is not None and not float(given.value) > 0):
            raise FormError(f"{name} is a number above 0")
    keys = [f for f in table.dataType.fields if f.name not in used]
    schema = T.StructType([*keys, *out])
    return AnalyzeResult(schema=schema, withSinglePartition=not keys, partitionBy=[PartitioningColumn(f"`{f.name}`") for f in keys], orderBy=order)


class SampleWindows:
    """(keys, start, end), window, n to keys, k, start, end: windows spread evenly over the room of all intervals that hold one.

    At most n, and no more than fit side by side in the room, counting one for each interval. Rows with a NULL end take no part.
    """

    @staticmethod
    def analyze(intervals: AnalyzeArgument, window: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        return _result(intervals, {"start": "seconds", "end": "seconds"}, {"window": window, "n": n}, [T.StructField("k", T.IntegerType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())], [OrderingColumn("start"), OrderingColumn("`end`")])

    def __init__(self):
        self.key, self.fit, self.window, self.n = None, [], 0.0, 0

    def eval(self, row: Row, window: float, n: int) -> None:
        self.window, self.n = float(window), int(n)
        self.key = tuple(v for name, v in zip(row.__fields__, row, strict=True) if name not in ("start", "end"))
        if row["start"] is not None and row["end"] is not None and row["end"] - row["start"] >= self.window:
            self.fit.append((float(row["start"]), float(row["end"]) - float(row["start"]) - self.window))

    def terminate(self):
        upto = list(itertools.accumulate(room for _, room in self.fit))
        if not upto:
            return
        n = min(self.n, int(upto[-1] // self.window) + len(upto))
        for k in range(n):
            at = (k + 0.5) * upto[-1] / n
            which = min(bisect.bisect_right(upto, at), len(upto) - 1)
            start, room = self.fit[which]
            begin = start + at - (upto[which] - room)
            yield (*self.key, k, begin, begin + self.window)


class LargestPeaks:
    """(keys, i, v), n, apart to keys, rank, i, v: the n largest samples of which no two are nearer than ``apart``; the earlier of equal ones first.

    Rows come in the order of v, so nothing is held but the peaks; the rest of a key's rows is skipped once there are n.
    """

    @staticmethod
    def analyze(samples: AnalyzeArgument, n: AnalyzeArgument, apart: AnalyzeArgument) -> AnalyzeResult:
        return _result(samples, {"i": "number", "v": "value"}, {"n": n, "apart": apart}, [T.StructField("rank", T.IntegerType()), T.StructField("i", T.LongType()), T.StructField("v", T.DoubleType())], [OrderingColumn("v", ascending=False, overrideNullsFirst=False), OrderingColumn("i")])

    def __init__(self):
        self.taken: list[int] = []

    def eval(self, row: Row, n: int, apart: float):
        if row["v"] is None or row["i"] is None or any(abs(row["i"] - j) < apart for j in self.taken):
            return
        if len(self.taken) >= n:
            raise SkipRestOfInputTableException("all peaks are found")
        self.taken.append(row["i"])
        yield (*(v for name, v in zip(row.__fields__, row, strict=True) if name not in ("i", "v")), len(self.taken), int(row["i"]), float(row["v"]))


def register(spark: SparkSession) -> None:
    """``sample_windows`` and ``largest_peaks`` in the session's SQL."""
    for name, made in (("sample_windows", SampleWindows), ("largest_peaks", LargestPeaks)):
        spark.udtf.register(name, F.udtf(made))
