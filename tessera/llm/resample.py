"""Importance resampling of a corpus towards a target distribution, over bucketed word runs.

Features are all runs of one to three words, hashed into buckets. A bucket's gain is the log ratio of its
smoothed shares in the target and in the corpus, a document's weight the sum of the gains of its features.
Documents are drawn without replacement by weight plus a Gumbel variate of their id: the highest scores.

Postings are inverted by bucket: for each block of documents and each few buckets a row holds (document, count)
lists, packed. These rows are shuffled by bucket; there the totals of both corpora meet, the gains follow, and
each task adds up what its buckets give to the documents of a block. The partial sums are shuffled by block
and reduced by document. A bucket has one row a block at most, however common it is, and no task holds more
than a bounded number of blocks.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cache, materialize, numbered, release, slices, small_batches

BUCKETS = 10_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
RUN = 3
WIDTH = 4  # buckets of a row
BLOCK = 4096  # documents of a block at most, below 2**16
MOST_POSTINGS = 8_000_000  # of a block in the making
PIECE = 4 << 20  # bytes of a text taken at a time
MOST_BLOCKS = 1024  # whose sums a task holds, 32 KB each
MOST_WORDS, MEMO_BYTES = 200_000, 40 << 20  # memo of a worker
DIRECT = 64


def crc_step(x: np.ndarray) -> np.ndarray:
    """The CRC register after one zero byte, bit by bit."""
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ np.where(x & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return x


class CrcShift:
    """crc32(a + b) = shift(crc32(a), len(b)) ^ crc32(b). A shift is linear: four look-ups of the register's bytes."""

    def __init__(self):
        byte = np.arange(256, dtype=np.uint32)
        tables = [np.stack([byte << np.uint32(8 * k) for k in range(4)])]
        for _ in range(DIRECT):
            tables.append(crc_step(tables[-1]))
        self.direct = np.stack(tables)
        self.powers = [self.direct[1]]  # shifts by 1, 2, 4, ... bytes

    @staticmethod
    def _by(table: np.ndarray, x: np.ndarray) -> np.ndarray:
        return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]

    def __call__(self, crcs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        near = np.minimum(sizes, DIRECT)
        out = self.direct[near, 0, crcs & 255] ^ self.direct[near, 1, (crcs >> 8) & 255] ^ self.direct[near, 2, (crcs >> 16) & 255] ^ self.direct[near, 3, crcs >> 24]
        for i in np.flatnonzero(sizes > DIRECT):
            x, left, k = crcs[i : i + 1], int(sizes[i]), 0
            while left:
                while len(self.powers) <= k:
                    self.powers.append(self._by(self.powers[-1], self.powers[-1]))
                x = self._by(self.powers[k], x) if left & 1 else x
                left, k = left >> 1, k + 1
            out[i] = x[0]
        return out


def word_sums(word: bytes) -> bytes:
    """crc32 of the word, of a space and the word, and the latter's length."""
    return np.array([zlib.crc32(word), zlib.crc32(b" " + word), len(word) + 1], "<u4").tobytes()


def pieces(data: bytes) -> Iterator[bytes]:
    """The text in pieces that end between words."""
    at = 0
    while at < len(data):
        end = at + PIECE
        cut = GAP.search(data, end) if end < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


def feature_counts(text: str | None, memo: dict, shift: CrcShift, buckets: int) -> tuple[np.ndarray, int]:
    """Features of the whole text by bucket, and its number of words."""
    counts, words = np.zeros(buckets, np.int64), 0
    last = np.empty((0, 3), np.uint32)
    for piece in pieces((text or "").encode("utf-8", "replace").lower()):
        new = np.frombuffer(b"".join(map(memo.__getitem__, WORD.findall(piece))), "<u4").reshape(-1, 3)
        if not len(new):
            continue
        words += len(new)
        v, old = np.concatenate([last, new]), len(last)
        crc = v[:, 0]
        counts += np.bincount(crc[old:] % np.uint32(buckets), minlength=buckets)
        for n in range(1, RUN):
            crc = shift(crc[:-1], v[n:, 2]) ^ v[n:, 1] if len(crc) > 1 else crc[:0]
            counts += np.bincount(crc[max(0, old - n) :] % np.uint32(buckets), minlength=buckets)
        last = v[-(RUN - 1) :]
    return counts, words


def pack(sizes: np.ndarray, docs: np.ndarray, counts: np.ndarray, codec: pa.Codec) -> tuple[bytes, int]:
    """Posting lists of WIDTH buckets: sizes, gaps between documents by byte planes, counts up to 254, the larger ones."""
    gaps = np.diff(docs, prepend=0)
    firsts = np.cumsum(sizes)[:-1]
    firsts = firsts[firsts < len(docs)]
    gaps[firsts] = docs[firsts]
    data = sizes.astype("<u2").tobytes() + (gaps & 255).astype(np.uint8).tobytes() + (gaps >> 8).astype(np.uint8).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()
    return codec.compress(data, asbytes=True), len(data)


def unpack(data: bytes, size: int, codec: pa.Codec) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket's place, documents, counts) of each bucket with postings."""
    data = codec.decompress(data, size, asbytes=True)
    sizes = np.frombuffer(data, "<u2", WIDTH).astype(np.int64)
    n, at = int(sizes.sum()), 2 * WIDTH
    low, high, small = (np.frombuffer(data, np.uint8, n, at + k * n) for k in range(3))
    gaps, counts = low + (high.astype(np.int64) << 8), small.astype(np.int64)
    counts[small == 255] = np.frombuffer(data, "<i8", offset=at + 3 * n)
    end = 0
    for k, own in enumerate(sizes):
        if own:
            yield k, np.cumsum(gaps[end : end + own]), counts[end : end + own]
            end += own


POSTINGS = "group int, block long, totals array<bigint>, data binary, size int, ids array<bigint>, words array<bigint>"
HEAD = -1  # group of the row that has a block's ids and word counts


def _zstd() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def _schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def postings(df: DataFrame, text: str, id_column: str, buckets: int) -> DataFrame:
    """Rows of POSTINGS: by block and WIDTH buckets the packed lists, and the block's head."""
    schema = _schema(df, POSTINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, shift, codec = Cache(word_sums, MOST_WORDS, MEMO_BYTES), CrcShift(), _zstd()
        number = TaskContext.get().partitionId() << 32
        ids, words, used, counts = [], [], [], []

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal number
            docs = np.repeat(np.arange(len(used), dtype=np.int64), [len(u) for u in used])
            flat, n = np.concatenate(used), np.concatenate(counts)
            order = np.argsort(flat, kind="stable")
            flat, docs, n = flat[order], docs[order], n[order]
            groups = np.unique(flat // WIDTH)
            edges = np.searchsorted(flat, (groups[:, None].astype(np.int64) * WIDTH + np.arange(WIDTH + 1)))
            sums = np.concatenate([[0], np.cumsum(n)])
            rows = [pack(np.diff(e), docs[e[0] : e[-1]], n[e[0] : e[-1]], codec) for e in edges]
            head = {"group": HEAD, "block": number, "totals": None, "data": None, "size": None, "ids": list(ids), "words": list(words)}
            yield pa.RecordBatch.from_pylist([head], schema)
            totals = np.diff(sums[edges], axis=1)
            for at in range(0, len(rows), 1000):  # rows are small, their number is bounded by the buckets
                part = slice(at, at + 1000)
                k = len(rows[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(groups[part].astype(np.int32)), pa.array([number] * k, pa.int64()), pa.array(list(totals[part]), pa.list_(pa.int64())), pa.array([r[0] for r in rows[part]], pa.binary()), pa.array([r[1] for r in rows[part]], pa.int32()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int64()))],
                    names=schema.names,
                )
            number += 1
            for held in (ids, words, used, counts):
                held.clear()

        held = 0
        for batch in slices(batches, text):
            for own, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, n = feature_counts(t.as_py(), memo, shift, buckets)
                places = np.flatnonzero(found).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
                ids.append(own)
                words.append(n)
                used.append(places)
                counts.append(found[places])
                held += len(places)
                if len(ids) == BLOCK or held >= MOST_POSTINGS:
                    yield from block()
                    held = 0
        if ids:
            yield from block()

    return df.select(F.col(id_column).cast("long").alias("_id"), F.col(text)).mapInArrow(run, POSTINGS)


def gain(s: int, t: int, all_s: int, all_t: int, buckets: int) -> int:
    return math.floor(1000 * math.log(float(t + 1) * float(all_s + buckets) / (float(s + 1) * float(all_t + buckets))))


PARTIAL = "block long, kind int, data binary, size int, ids array<bigint>, words array<bigint>"


def _partials(dealt: DataFrame, all_s: int, all_t: int, buckets: int) -> DataFrame:
    """What the buckets of a task give to the documents of each block. dealt: sorted by group and kind (totals of the corpus, of the target, postings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, gains, group, totals = _zstd(), [], None, {}
        sums: dict[int, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            blocks = sorted(sums)
            for at in range(0, len(blocks), 64):
                part = blocks[at : at + 64]
                raw = [sums[b].astype("<i8").tobytes() for b in part]
                k = len(part)
                packed = [codec.compress(np.frombuffer(r, np.uint8).reshape(-1, 8).T.tobytes(), asbytes=True) for r in raw]  # byte planes
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([1] * k, pa.int32()), pa.array(packed, pa.binary()), pa.array([len(r) for r in raw], pa.int32()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int64()))], names=["block", "kind", "data", "size", "ids", "words"])
            sums.clear()

        for batch in batches:
            for own, kind, block, total, data, size in zip(*(batch.column(c).to_pylist() for c in ("group", "kind", "block", "totals", "data", "size")), strict=True):
                if own != group:
                    group, totals, gains = own, {}, []
                if kind < 2:
                    totals[kind] = total
                    continue
                if not gains:
                    none = [0] * WIDTH
                    gains = [gain(s, t, all_s, all_t, buckets) for s, t in zip(totals.get(0, none), totals.get(1, none), strict=True)]
                if block not in sums and len(sums) >= MOST_BLOCKS:
                    yield from rows()
                held = sums.setdefault(block, np.zeros(BLOCK, np.int64))
                for k, docs, counts in unpack(data, size, codec):
                    if gains[k]:
                        held[docs] += counts * gains[k]
        yield from rows()

    return dealt.mapInArrow(run, PARTIAL)


def _reduced(dealt: DataFrame) -> DataFrame:
    """Documents from heads and partial sums, sorted by block and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, block, ids, words, total = _zstd(), None, [], [], np.zeros(0, np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(total[: len(ids)])], names=["id", "words", "weight"])

        for batch in batches:
            for own, kind, data, size, own_ids, own_words in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "data", "size", "ids", "words")), strict=True):
                if own != block:
                    yield from rows()
                    block, ids, words, total = own, [], [], np.zeros(BLOCK, np.int64)
                if kind == 0:
                    ids, words = own_ids, own_words
                else:
                    planes = np.frombuffer(codec.decompress(data, size, asbytes=True), np.uint8).reshape(8, -1)
                    total += np.frombuffer(planes.T.tobytes(), "<i8")
        yield from rows()

    return dealt.mapInArrow(run, "id long, words long, weight long")


def gumbel(id_column: str, seed: int) -> Column:
    """floor(1000 g) of a standard Gumbel variate g that depends on the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(df: DataFrame, target: DataFrame, *, text: str = "text", id_column: str = "doc_id", target_text: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """Every row of ``df`` as its id (a long) with n_features, weight, score and rank, all longs.

    Of the rows with ``least_words`` words or more, ``percent`` in a hundred (rounded down) are drawn and ranked
    from 1; the others' rank is null. Ties go to the smaller id, null ids last. Null and empty texts have no
    features and weight 0. Rows are weighed one by one, so rows of one id may differ in weight but share their
    variate, that of a null id being the empty id's. A very long text is read in pieces that end between words.
    Where the corpus or the target is empty its share of every bucket is the same. Further columns are not read.
    """
    spark = df.sparkSession
    small_batches(spark)
    corpus = materialize(postings(df, text, id_column, buckets), "postings")
    aim = materialize(postings(target.select(F.lit(None).alias("_none"), F.col(target_text)), target_text, "_none", buckets).where(F.col("group") != HEAD).drop("data", "ids", "words"), "target-totals")
    per_group = lambda rows, kind: rows.where(F.col("group") != HEAD).groupBy("group").agg(F.array(*(F.sum(F.col("totals")[i]) for i in range(WIDTH))).alias("totals")).withColumn("kind", F.lit(kind))
    totals = materialize(per_group(corpus, 0).unionByName(per_group(aim, 1)), "bucket-totals")
    sums = {r["kind"]: r["n"] for r in totals.groupBy("kind").agg(F.sum(F.aggregate("totals", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")).collect()}
    lists = corpus.where(F.col("group") != HEAD).select("group", F.lit(2).alias("kind"), "block", F.lit(None).cast("array<bigint>").alias("totals"), "data", "size")
    dealt = totals.unionByName(lists, allowMissingColumns=True).repartition("group").sortWithinPartitions("group", "kind", "block")
    heads = corpus.where(F.col("group") == HEAD).select("block", F.lit(0).alias("kind"), "data", "size", "ids", "words")
    partial = _partials(dealt, sums.get(0, 0), sums.get(1, 0), buckets)
    found = _reduced(heads.unionByName(partial).repartition("block").sortWithinPartitions("block", "kind"))
    n = F.col("words")
    features = sum((F.greatest(n - k, F.lit(0)) for k in range(1, RUN)), n).cast("long")
    rows = found.select(F.col("id").alias(id_column), "words", features.alias("n_features"), "weight", (F.col("weight") + gumbel("id", seed)).alias("score"))
    rows = materialize(rows, "scores")
    release(corpus, aim, totals)
    known = rows.where(n >= least_words)
    most = known.count() * percent // 100
    placed = numbered(known.withColumn("_all", F.lit("")), "_all", [F.col("score").desc(), F.col(id_column).asc_nulls_last(), F.col("n_features")], place="_place", count="_of")
    rank = F.when(F.col("_place") < most, F.col("_place") + 1)
    columns = [id_column, "n_features", "weight", "score"]
    return placed.select(*columns, rank.alias("rank")).unionByName(rows.where(n < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))
