"""Approximate nearest neighbours: a forest of random-projection trees.

Trees are grown on a bounded sample, large enough for leaves of about ``leaf_rows`` of the table's rows,
however many rows there are, up to most_sample / 16 leaves a tree; beyond, leaves grow with the table. A node splits its points at the median of their projection on the
difference of two of them. Every row of the table then goes to its leaf of each tree. A query walks all
trees through one priority queue, whose entries are subtrees ranked by the least margin by which the
query missed them, until it has visited its budget of leaves. The rows of these leaves are reranked by
exact inner products in double precision.

The budget is measured, not guessed: for a bounded set of test queries the true neighbours are found by
brute force, and the budget is the least number of leaves that finds ``recall`` of them. Vectors
without structure thus get a large budget, clustered ones a small one.

Rows and queries meet by (tree, leaf); leaves are cut into blocks of bounded size, so that a leaf
with very many equal vectors is dealt out too, and only a block's best ids for each query leave it. Repeated rows are one row, and
ids are counted wherever k of them are asked for.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_share, listed, materialize


@dataclass
class Forest:
    """Nodes of all trees. A leaf has child -1 and a leaf number, which is unique over the trees."""

    roots: list[int]
    normals: np.ndarray
    cuts: np.ndarray
    children: np.ndarray  # (nodes, 2)
    leaf: np.ndarray
    leaves: int


def grow(points: np.ndarray, *, trees: int, leaf_points: int, seed: int = 11) -> Forest:
    rng = np.random.default_rng(seed)
    normals, cuts, children, leaf, roots = [], [], [], [], []
    count = 0

    def node(rows: np.ndarray) -> int:
        nonlocal count
        me = len(normals)
        normals.append(np.zeros(points.shape[1]))
        cuts.append(0.0)
        children.append([-1, -1])
        leaf.append(-1)
        for _ in range(5 if len(rows) > leaf_points else 0):
            a, b = points[rng.choice(rows, 2, replace=False)]
            side = points[rows] @ (a - b)
            cut = float(np.median(side))
            low = side < cut
            if 0.25 <= low.mean() <= 0.75:  # else nearly all project alike
                normals[me], cuts[me] = a - b, cut
                children[me] = [node(rows[low]), node(rows[~low])]
                return me
        leaf[me] = count
        count += 1
        return me

    for _ in range(trees):
        roots.append(node(np.arange(len(points))))
    return Forest(roots, np.array(normals), np.array(cuts), np.array(children), np.array(leaf), count)


def leaves_of(forest: Forest, x: np.ndarray) -> np.ndarray:
    """The leaf of each row in each tree, (rows, trees). Products are summed in a fixed order."""
    out = np.empty((len(x), len(forest.roots)), np.int32)
    for t, root in enumerate(forest.roots):
        at = np.full(len(x), root)
        while (inner := np.flatnonzero(forest.leaf[at] < 0)).size:
            n = at[inner]
            right = (x[inner] * forest.normals[n]).sum(axis=1) >= forest.cuts[n]
            at[inner] = forest.children[n, right.astype(int)]
        out[:, t] = forest.leaf[at]
    return out


class Margins:
    """A query's signed distance from the cut of a node, worked out for the nodes that are asked for: a walk's memory is its path's."""

    def __init__(self, forest: Forest, x: np.ndarray):
        self.forest, self.x = forest, x

    def __getitem__(self, at: int) -> float:
        return float(self.forest.normals[at] @ self.x - self.forest.cuts[at])


def visit_order(forest: Forest, margins: Margins | np.ndarray, budget: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
    """The leaves one query visits, best first. margins: its signed distance from the cut of each node, by number."""
    queue = [(-np.inf, root) for root in forest.roots]
    heapq.heapify(queue)
    out, rows = [], 0
    while queue and (len(out) < budget or rows < least):
        missed, at = heapq.heappop(queue)
        while forest.leaf[at] < 0:
            margin = margins[at]
            right = margin >= 0
            heapq.heappush(queue, (max(missed, abs(margin)), int(forest.children[at, int(not right)])))
            at = int(forest.children[at, int(right)])
        out.append(int(forest.leaf[at]))
        rows += 0 if sizes is None else int(sizes[out[-1]])
    return out


def matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors as rows in double precision; 4 or 8 bytes a component, as the table has them."""
    data = b"".join(vectors)
    return np.frombuffer(data, "<f4" if not vectors or len(vectors[0]) == 4 * dim else "<f8").reshape(-1, dim).astype(float)


def usable(vector: Column, dim: int) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def best(starts: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the best rows of the k best ids, and of all that might tie with them after exact summing.

    Rows are sorted by id; ``starts`` are the places where the next id begins.
    """
    tops = scores if len(starts) == len(scores) else np.maximum.reduceat(scores, starts)
    kth = np.partition(tops, len(tops) - k)[len(tops) - k] if len(tops) > k else -np.inf
    floor = tops if len(tops) < len(scores) else np.full(len(tops), kth)
    floor = np.maximum(floor, kth)
    floor = np.where(np.isfinite(floor), floor - 1e-9 * np.maximum(1.0, np.abs(floor)), floor)
    return np.flatnonzero(scores >= np.repeat(floor, np.diff(np.append(starts, len(scores)))))


def exact_best(ids: np.ndarray, starts: np.ndarray, x: np.ndarray, query: np.ndarray, own: int, approx: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids of ``x`` (sorted by id) for a query but its own: ids and products, each summed in the same order."""
    near = best(starts, np.where(ids == own, -np.inf, approx), k)
    near = near[ids[near] != own]
    score = (x[near] * query).sum(axis=1)
    first = np.lexsort((ids[near], -score))
    if len(starts) < len(ids):  # an id's best row comes first, its others go
        first = first[np.sort(np.unique(ids[near][first], return_index=True)[1])]
    return ids[near][first[:k]], score[first[:k]]


def id_starts(ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))


def nearest_neighbours(
    df: DataFrame, *, id_column: str = "vec_id", vector: str = "embedding", query: Column | None = None, k: int = 20, trees: int = 3, most_sample: int = 1 << 17,
    least_sample: int = 8192, leaf_rows: int = 2048, leaves: int = 32, recall: float = 0.95, test_queries: int = 128, block: int = 4096, seed: int = 11,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row that ``query`` marks (by default all), by inner product.

    The forest has one leaf for each ``leaf_rows`` different rows, ``leaves`` at least. Its sample (16 rows a leaf, between
    ``least_sample`` and ``most_sample`` rows), the test queries and the leaf sizes (as many as leaves) come to the
    driver; all are bounded by parameters. Rows take no part whose id or vector is null, whose
    vector is zero, has a null or non-finite component, or another length than most. Rows with the same
    id count as forms of one vector: their best product counts, and none is its own neighbour. With k
    candidates or fewer all are returned; ties go to the smaller id. Empty tables give no rows; further columns are not read.
    """
    spark = df.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    lengths = df.groupBy(F.size(F.col(vector)).alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], out)
    dim = lengths["n"]
    kind = "float" if df.schema[vector].dataType.elementType.simpleString() == "float" else "double"
    packing = {"float": "<f4", "double": "<f8"}[kind]
    is_query = F.lit(True) if query is None else F.coalesce(query, F.lit(False))
    rows = df.where(F.col(id_column).isNotNull() & usable(F.col(vector), dim)).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"), is_query.alias("is_query"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(packing).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in v], pa.binary()), b.column("is_query")], names=["id", "v", "is_query"])

    rows = rows.mapInArrow(packed, "id long, v binary, is_query boolean").groupBy("id", "v").agg(F.max("is_query").alias("is_query"))
    rows = materialize(rows, "ann-rows")
    n = rows.count()
    leaves = max(leaves, min(-(-n // leaf_rows), most_sample // 16))
    sample = sorted(rows.where(hash_share(["id", "v"], n, max(least_sample, 16 * leaves))).select("id", "v").collect())
    if not sample:
        return spark.createDataFrame([], out)
    points = matrix([bytes(r[1]) for r in sample], dim)
    forest = grow(points, trees=trees, leaf_points=-(-len(points) // leaves) if len(points) < n else max(2 * k, -(-len(points) // leaves)), seed=seed)
    shared = spark.sparkContext.broadcast(forest)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = leaves_of(shared.value, matrix(b.column("v").to_pylist(), dim))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), b.column("is_query"), pa.array(list(at), pa.list_(pa.int32()))], names=["id", "v", "is_query", "leaves"])

    indexed = materialize(rows.mapInArrow(index, "id long, v binary, is_query boolean, leaves array<int>"), "ann-index")
    sizes = np.zeros(forest.leaves, np.int64)
    for r in indexed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():
        sizes[r[0]] = r[1]
    # An id counts in one leaf of each tree, so that the sum over a tree's leaves is never more than its different ids
    owners = np.zeros(forest.leaves, np.int64)
    once = indexed.groupBy("id").agg(*(F.min(F.col("leaves")[t]).alias(f"t{t}") for t in range(trees)))
    for r in once.select(F.explode(F.array(*(f"t{t}" for t in range(trees)))).alias("leaf")).groupBy("leaf").count().collect():
        owners[r[0]] = r[1]
    n_queries = indexed.where("is_query").count()

    # The budget, from brute force for a few queries
    tests = sorted(indexed.where("is_query").where(hash_share(["id", "v"], n_queries, test_queries)).select("id", "v").collect())
    if not tests:
        return spark.createDataFrame([], out)
    test_ids = np.array([r[0] for r in tests])
    test_x = matrix([bytes(r[1]) for r in tests], dim)
    sent = spark.sparkContext.broadcast((test_ids, test_x))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = sent.value
        for b in batches:
            if b.num_rows:
                x, ids, at = matrix(b.column("v").to_pylist(), dim), b.column("id").to_numpy(), b.column("leaves")
                for i, s in enumerate(q @ x.T):
                    s = np.where(ids == own[i], -np.inf, s)
                    near = np.argsort(-s, kind="stable")[: np.isfinite(s).sum()]
                    near = near[np.sort(np.unique(ids[near], return_index=True)[1])[:k]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), i, np.int32)), pa.array(s[near]), pa.array(ids[near]), at.take(pa.array(near))], names=["q", "s", "id", "leaves"])

    top = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    true = indexed.mapInArrow(brute, "q int, s double, id long, leaves array<int>").groupBy("q", "id").agg(F.max(F.struct("s", "leaves")).alias("x")).select("q", "id", "x.s", "x.leaves")
    true = true.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).select("q", "leaves").collect()
    ranks = [{leaf: r for r, leaf in enumerate(visit_order(forest, Margins(forest, q), forest.leaves))} for q in test_x]
    found = np.sort([min(ranks[r["q"]][leaf] for leaf in r["leaves"]) for r in true])
    budget = int(found[min(len(found) - 1, int(np.ceil(recall * len(found))) - 1)]) + 1 if len(found) else forest.leaves

    # Queries go to the leaves they visit; leaves are cut into blocks of rows
    blocks = np.maximum(1, -(-sizes // block))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v").to_pylist(), dim)
                seen = [visit_order(own, Margins(own, q), budget, owners, 4 * k) for q in x]
                who = np.repeat(np.arange(len(x)), [len(s) for s in seen])
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(who)), b.column("v").take(pa.array(who)), pa.array(np.concatenate(seen).astype(np.int32))], names=["id", "v", "leaf"])

    cut = listed(spark, [(i, int(c)) for i, c in enumerate(blocks)], "leaf int, blocks int")
    asked = indexed.where("is_query").mapInArrow(search, "id long, v binary, leaf int").join(cut, "leaf")
    asked = asked.select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "id", "v")
    held = indexed.select("id", "v", F.explode("leaves").alias("leaf")).join(cut, "leaf")
    held = held.select("leaf", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int").alias("part"), "id", "v")
    # A block's queries are dealt to as many tasks as they fill blocks; their number is counted first.
    counted = asked.groupBy("leaf", "part").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("deals"))
    held = held.join(counted, ["leaf", "part"]).select("leaf", "part", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), "id", "v")
    asked = asked.join(counted, ["leaf", "part"]).select("leaf", "part", F.pmod(F.xxhash64("id", "v"), F.col("deals")).cast("int").alias("deal"), "id", "v")

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "ids": [], "scores": []})
        q = matrix(list(left["v"]), dim)
        right = right.sort_values("id")
        x = matrix(list(right["v"]), dim)
        ids, rows_ = right["id"].to_numpy(), []
        starts = id_starts(ids)
        for at in range(0, len(q), 256):
            for i, s in enumerate(q[at : at + 256] @ x.T, at):
                own = int(left["id"].iloc[i])
                near, score = exact_best(ids, starts, x, q[i], own, s, k)
                rows_.append((own, near, score))
        return pd.DataFrame(rows_, columns=["query_id", "ids", "scores"])

    key = ["leaf", "part", "deal"]
    near = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(rerank, "query_id long, ids array<long>, scores array<double>")
    each = near.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).groupBy("query_id", F.col("x.ids").alias("vec_id")).agg(F.max("x.scores").alias("score"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
