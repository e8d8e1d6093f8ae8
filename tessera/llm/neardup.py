"""MinHash near-dedup with sequential Bayesian verification.

1. A document's set is its distinct word shingles as 64-bit hashes; documents with equal sets form a
   class, of which the smallest id goes on.
2. Signatures of up to 256 minima are cut into bands, as many and as wide as the miss probability at the
   threshold allows; classes that agree in a band are candidates.
3. Each band bucket's classes are compared with the bucket's smallest one only (a star). Signatures are
   compared batch by batch; after each, a pair goes if the posterior probability that its similarity
   reaches the threshold is under ``miss`` (uniform prior, so the posterior is a beta distribution).
   Survivors are confirmed on their full sets. Confirmed links give components.
4. What a star can't tell are links between two of a centre's candidates that lie in different components.
   The candidates of such a centre are cut into blocks of bounded size; a task has two blocks. It compares
   their signatures batch by batch, and only classes with a survivor go on. A second pass confirms the
   survivors on their full sets, and only links that join components leave it. Candidates of the largest
   component meet only those outside it. The components of all links are the result.

So every pair that shares a band is either confirmed, refused, or already connected, while a bucket of n
copies costs n comparisons and no list of its pairs is ever made.

No key gathers rows without bound: a centre's candidates are dealt by a hash of the candidate to as many
parts as the size of its bucket asks for, and what is joined to them by the centre is copied once a part;
buckets and classes, whose rows are narrow, are dealt to a fixed number of parts.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, materialize, release, slices, small_batches

MINIMA = 256
BATCH = 32  # minima compared before each look at the posterior
MOST_WORDS, MEMO_BYTES = 100_000, 20 << 20  # memo of a worker
BLOCK = 256  # classes in a block
PART = 512  # candidates of a centre that are joined in one place
PART_ROWS = 2048  # rows of a bucket or class that are joined in one place

_rng = np.random.default_rng(20_240_229)
FACTORS = _rng.integers(1 << 62, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hash(word: bytes) -> bytes:
    return xxhash.xxh64_digest(word)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (splitmix64's constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit shingles: A-Z lower-cased, words between ASCII white space."""
    found = text.encode("utf-8", "replace").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(memo.__getitem__, found)), ">u8").astype(np.uint64)
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The high 32 bits of each factor's least product."""
    out = np.full(MINIMA, ~np.uint64(0))
    for at in range(0, len(shingles), 2048):
        np.minimum(out, (shingles[at : at + 2048, None] * FACTORS).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype("<u4")


@functools.cache
def band_shape(threshold: float, miss: float) -> tuple[int, int]:
    """Rows and bands: the widest bands that miss a pair at the threshold with at most this probability."""
    for rows in range(16, 0, -1):
        if (1 - threshold**rows) ** (MINIMA // rows) <= miss:
            return rows, MINIMA // rows
    return 1, MINIMA


@functools.cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """By number of batches compared: the fewest equal minima with which a pair goes on.

    With a uniform prior, P(similarity >= t | m of n equal) is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, MINIMA + 1, BATCH):
        below, m = 0.0, 0
        while (below := below + math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < miss:
            m += 1
        out.append(m)
    return tuple(out)


def survivors(own: np.ndarray, others: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Rows of ``others`` that no batch of ``own``'s signature (or row of signatures) rules out."""
    left, equal = np.arange(len(others)), np.zeros(len(others), np.int64)
    for k, m in enumerate(least):
        if not len(left):
            break
        at = slice(k * BATCH, (k + 1) * BATCH)
        equal = equal + ((own[left, at] if own.ndim == 2 else own[at]) == others[left, at]).sum(axis=1)
        go = equal >= m
        left, equal = left[go], equal[go]
    return left


def signatures_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, MINIMA)


def _signed(df: DataFrame, text: str, id_column: str, words: int, threshold: float, miss: float) -> DataFrame:
    """id, n_shingles, key_a, key_b (128 bits of the set), signature (16 bits of each minimum), bands."""
    rows, bands = band_shape(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Cache(word_hash, MOST_WORDS, MEMO_BYTES)
        number = np.arange(bands, dtype=np.uint64)
        for batch in slices(batches, "_text"):
            n, a, b, sig, band = [], [], [], [], []
            for t in batch.column("_text").to_pylist():
                s = shingle_set(t, words, memo)
                n.append(len(s))
                d = xxhash.xxh3_128_digest(s.tobytes())
                a.append(int.from_bytes(d[:8], "little", signed=True))
                b.append(int.from_bytes(d[8:], "little", signed=True))
                if len(s):
                    m = minima(s)
                    h = number * np.uint64(0xD6E8FEB86659FD93)
                    for r in range(rows):
                        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + m[r : rows * bands : rows])
                    sig.append(m.astype("<u2").tobytes())
                    band.append(h.view(np.int64))
                else:
                    sig.append(None)
                    band.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sig, pa.binary()), pa.array(band, pa.list_(pa.int64()))], names=["id", "n_shingles", "key_a", "key_b", "signature", "bands"])

    return df.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("_text")).mapInArrow(run, "id long, n_shingles long, key_a long, key_b long, signature binary, bands array<long>")


def _carried(pairs: DataFrame, payload: DataFrame) -> DataFrame:
    """Pairs (a, b) with the payload of both, of_a and of_b. ``part`` deals out the pairs of a common id.

    payload: id and one more column. It is copied once for each part its id is in, so no id's pairs meet in one place.
    """
    (what,) = (c for c in payload.columns if c != "id")
    dealt = payload.join(pairs.select(F.explode(F.array("a", "b")).alias("id"), "part").distinct(), "id")
    for side in ("b", "a"):
        pairs = pairs.join(dealt.select(F.col("id").alias(side), "part", F.col(what).alias(f"of_{side}")), [side, "part"])
    return pairs.select("a", "b", "part", "of_a", "of_b")


def _plausible(pairs: DataFrame, signatures: DataFrame, least: tuple[int, ...]) -> DataFrame:
    """Pairs (a, b, part) that their signatures don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.select(["a", "b", "part"]).take(pa.array(survivors(signatures_of(b.column("of_a")), signatures_of(b.column("of_b")), least)))

    return _carried(pairs, signatures).mapInArrow(run, "a long, b long, part long")


def _sets(df: DataFrame, needed: DataFrame, text: str, id_column: str, words: int) -> DataFrame:
    """id, shingles (binary) of the needed ids; an id has a row for each different set. Written once."""
    texts = df.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("_text")).join(needed, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Cache(word_hash, MOST_WORDS, MEMO_BYTES)
        for batch in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, words, memo).tobytes() for t in batch.column("_text").to_pylist()], pa.binary())], names=["id", "shingles"])

    found = materialize(texts.mapInArrow(run, "id long, shingles binary"), "near-sets").withColumn("h", F.xxhash64("shingles"))
    return found.where(F.length("shingles") > 0).repartition("id").dropDuplicates(["id", "h"]).select("id", "shingles")


def similar(x: int, y: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (x + y - common)


def _confirmed(pairs: DataFrame, sets_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough: 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "of_b"):
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("of_a"), batch.column("of_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and similar(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), percent):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return _carried(pairs, sets_).mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every id in links (a, b), by alternating large and small stars.

    Each round links every id's larger neighbours to its smallest one, then its smaller ones; it ends when
    a round changes nothing. Ids grow only with the links; nothing is collected but a count and a sum.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = written = None
    while True:
        edges = materialize(edges, "near-stars")
        release(written)
        written = edges
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = large.join(least, "u").select("v", "m", "u")
        edges = edges.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


TASK = ["centre", "l", "r"]
MEMBER = "centre long, l int, r int, is_left boolean, id long, component long, outside boolean"


def _tasks(members: DataFrame) -> DataFrame:
    """Rows of pairs of blocks: centre, l, r, is_left, id, component, outside.

    members: centre, n (its candidates), m (those outside its largest component), id, component, outside. Ids outside
    are cut into left blocks, all ids of the centre into right blocks; each pair of blocks is one task's work.
    """
    rows = members.select("*", F.ceil(F.col("n") / BLOCK).cast("int").alias("rights"), F.ceil(F.col("m") / BLOCK).cast("int").alias("lefts"))
    deal, upto = F.xxhash64("id"), lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = rows.where("outside").select("centre", F.pmod(deal, F.col("lefts")).cast("int").alias("l"), upto("rights").alias("r"), F.lit(True).alias("is_left"), "id", "component", "outside")
    return left.unionByName(rows.select("centre", upto("lefts").alias("l"), F.pmod(deal, F.col("rights")).cast("int").alias("r"), F.lit(False).alias("is_left"), "id", "component", "outside"))


def _gathered(tasks: DataFrame) -> DataFrame:
    """Each task's rows one after the other, those of its right block first."""
    n = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks.repartition(n, *TASK).sortWithinPartitions(*TASK, "is_left", "id")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one task each, from batches clustered by task."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        key = [held.column(c).to_numpy() for c in TASK]
        cuts = np.flatnonzero(np.any([np.diff(k) != 0 for k in key], axis=0)) + 1
        first = 0
        for end in cuts:
            yield held.slice(first, end - first)
            first = int(end)
        held = held.slice(first)
    if held is not None and held.num_rows:
        yield held


def _block_pairs(group: pa.Table, least: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """(place of a left row, places of right rows) that may be linked: of different components, not ruled out by their signatures."""
    is_left, outside, ids, comp = (group.column(c).to_numpy() for c in ("is_left", "outside", "id", "component"))
    sig, rights = signatures_of(group.column("signature").combine_chunks()), np.flatnonzero(~is_left)
    for i in np.flatnonzero(is_left):
        go = rights[(comp[rights] != comp[i]) & (~outside[rights] | (ids[rights] > ids[i]))]  # two outside meet once
        if len(go := go[survivors(sig[i], sig[go], least)]):
            yield int(i), go


def _plausible_members(tasks: DataFrame, signatures: DataFrame, least: tuple[int, ...]) -> DataFrame:
    """The rows of ``tasks`` that have a plausible partner in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            keep = np.zeros(group.num_rows, bool)
            for i, go in _block_pairs(group, least):
                keep[i] = keep[go] = True
            if keep.any():
                yield from group.drop_columns("signature").filter(pa.array(keep)).combine_chunks().to_batches()

    return _gathered(tasks.join(signatures, "id").select(*(c.split()[0] for c in MEMBER.split(", ")), "signature")).mapInArrow(run, MEMBER)


def _linked(tasks: DataFrame, signatures: DataFrame, sets_: DataFrame, least: tuple[int, ...], percent: int) -> DataFrame:
    """Links (a, b) inside each task, confirmed on full sets; only those that join components not yet joined in it.

    A task numbers the shingles of its rows once; a pair costs one look-up by shingle of the right set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            ids, comp = group.column("id").to_numpy(), group.column("component").to_numpy()
            found = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
            names, numbers = np.unique(np.concatenate(found), return_inverse=True)
            starts = np.cumsum([0, *map(len, found)])
            held, root, pairs = np.zeros(len(names), bool), {}, []

            def top(x: int, root: dict[int, int] = root) -> int:
                while x in root:
                    x = root[x]
                return x

            for i, go in _block_pairs(group, least):
                own = numbers[starts[i] : starts[i + 1]]
                held[own] = True
                for j in go:
                    x, y, other = top(int(comp[i])), top(int(comp[j])), numbers[starts[j] : starts[j + 1]]
                    if x != y and similar(len(own), len(other), int(held[other].sum()), percent):
                        root[max(x, y)] = min(x, y)
                        pairs.append((int(ids[i]), int(ids[j])))
                held[own] = False
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], names=["a", "b"])

    both = tasks.join(signatures, "id").join(sets_, "id")
    return _gathered(both.select(*(c.split()[0] for c in MEMBER.split(", ")), "signature", "shingles")).mapInArrow(run, "a long, b long").distinct()


def _dealt(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` (with id) joined with their group's row (keys, size): a group of many rows is joined in as many parts as it fills.

    What groups those are is one narrow table, a row for each PART_ROWS rows at most; all other groups are one part.
    """
    deals = F.ceil(F.col("size") / PART_ROWS).cast("long")
    large = materialize(groups.where(F.col("size") > PART_ROWS).select(*keys, deals.alias("deals")), "near-large")
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("deals")), F.lit(0).cast("long"))
    placed = rows.join(large, keys, "left").withColumn("part", part).drop("deals")
    copies = groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), deals - 1)))
    return placed.join(copies, [*keys, "part"], how)


def near_duplicates(df: DataFrame, *, text: str = "text", id_column: str = "doc_id", words: int = 5, percent: int = 80, miss: float = 1e-4) -> DataFrame:
    """By row: id, n_shingles (size of its set), component_id (smallest id reachable by links), kept (it is its own).

    Linked are documents with 100 * intersection >= percent * union of their shingle sets; a text with
    fewer words than a shingle is one shingle, a text without words (or null) has an empty set and is
    linked with nothing. Equal sets are linked at once. ``miss`` bounds the probability that a pair at the
    threshold shares no band, and the posterior under which a pair goes. Ids should be unique: rows that
    share one are judged by their own text, and a link of any of their texts holds for the id. Rows without
    an id stay alone, with a null component, and are kept. A very long text is one row's work: its set and its
    signature are made in one task, from the whole text. Further columns are not read;
    an empty table gives no rows.
    """
    small_batches(df.sparkSession)
    threshold = percent / 100
    least = least_matches(threshold, miss)
    signed = materialize(_signed(df, text, id_column, words, threshold, miss), "near-signatures")
    usable = signed.where("n_shingles > 0 and id is not null")
    classes = materialize(usable.groupBy("key_a", "key_b").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count(F.lit(1)).alias("size")), "near-classes")
    firsts = usable.join(classes.select(F.col("rep").alias("id"), "key_a", "key_b"), ["id", "key_a", "key_b"], "left_semi")
    banded = firsts.select("id", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("last"), F.count(F.lit(1)).alias("size")).where("a < last")
    members = materialize(_dealt(banded, buckets, ["bucket"]).select("a", "id", "size"), "near-buckets")
    signatures = firsts.join(members.select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "key_a", "key_b"]).select("id", "signature")
    signatures = materialize(signatures, "near-banded")
    # A pair's part is a hash of its candidate, over as many parts as its largest bucket asks for; small buckets have the part 0.
    star = members.where("id <> a").groupBy("a", F.col("id").alias("b")).agg(F.max("size").alias("size"))
    star = materialize(star.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / PART)).cast("long").alias("part")), "near-stars-of")
    pairs = materialize(_plausible(star, signatures, least), "near-pairs")
    sets_ = _sets(df, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), text, id_column, words)
    links = materialize(_confirmed(pairs, sets_, percent), "near-links")
    found = materialize(components(links), "near-components")
    near = star.join(found.withColumnRenamed("id", "b"), "b", "left").select(F.col("a").alias("centre"), "part", F.col("b").alias("id"), F.coalesce("component", "b").alias("component"))
    # One row for each centre with candidates in several components, copied to the parts it has
    counts = near.groupBy("centre", "component").agg(F.count(F.lit(1)).alias("k"))
    open_ = counts.groupBy("centre").agg(F.max_by("component", F.struct("k", "component")).alias("largest"), F.sum("k").alias("n"), (F.sum("k") - F.max("k")).alias("m")).where("m > 0")
    open_ = open_.join(star.select(F.col("a").alias("centre"), "part").distinct(), "centre")
    near = near.join(open_, ["centre", "part"]).select("centre", "n", "m", "id", "component", (F.col("component") != F.col("largest")).alias("outside"))
    tasks = materialize(_plausible_members(_tasks(near), signatures, least), "near-tasks")
    sets_ = _sets(df, tasks.select("id").distinct(), text, id_column, words)
    final = components(links.unionByName(_linked(tasks, signatures, sets_, least, percent)))
    # A class's component reaches its rows in parts, as a class may hold a third of all rows
    known = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").where("rep < last or component is not null")
    known = materialize(known.select("key_a", "key_b", "size", F.coalesce("component", "rep").alias("component")), "near-known")
    release(classes, members, signatures, star, pairs, links, found, tasks)
    joined = _dealt(signed.select("id", "n_shingles", "key_a", "key_b"), known, ["key_a", "key_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return joined.select("id", "n_shingles", component.alias("component_id")).select(F.col("id").alias(id_column), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
