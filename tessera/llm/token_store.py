"""Token-ID / binary output: directly addressable codes.

A shard holds the ids of consecutive documents. An id is cut into chunks of 8 bits, lowest first. Level
0 has the first chunk of every id, level k the k-th chunk of those ids that need more than k chunks.
Each level but the last has a bitmap that says which ids go on, and a rank directory with the number
of set bits before every 512th. So id i is found by one look at each level it reaches: its place in
level k+1 is the rank of its place in level k. No block is ever decoded.

Layout of a shard, all integers little-endian: ``TDAC``, version (1 byte), levels (1 byte), 2 zero
bytes, ids (8 bytes); then for each level: entries (8 bytes), chunks (1 byte each), bitmap (8 bytes for
each 64 entries), directory (4 bytes for each 512 entries).

Shards are rows of a Parquet table (a container that every store Spark reads can hold): part, shard,
doc_ids and n_tokens of its documents in order, before (ids of the part's earlier shards), tokens, codes.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PLAIN, SPLIT, byte_letters, plain_forms
from .common import Cache, listed, materialize, slices, small_batches

MAGIC = b"TDAC"
ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
SHARD_TOKENS = 1 << 19  # a shard ends with the document that reaches so many
MEMO_BYTES = 96 << 20  # of a worker
SLICE_BYTES = 1 << 20  # texts in work at once


def pack(ids: np.ndarray) -> bytes:
    """The shard of unsigned 32-bit ids."""
    left = np.asarray(ids, np.uint32)
    levels = []
    while True:
        on = left > 255
        last = not on.any()
        bits = b"" if last else np.packbits(on, bitorder="little").tobytes()
        bits += b"\0" * (-len(bits) % 8)
        ranks = b""
        if not last:
            each = np.add.reduceat(ONES[np.frombuffer(bits, np.uint8)], np.arange(0, len(bits), 64), dtype=np.int64)
            ranks = np.concatenate([[0], np.cumsum(each)[:-1]]).astype("<u4").tobytes()
        levels.append(struct.pack("<q", len(left)) + left.astype(np.uint8).tobytes() + bits + ranks)
        if last:
            return MAGIC + struct.pack("<BBHq", 1, len(levels), 0, len(ids)) + b"".join(levels)
        left = left[on] >> np.uint32(8)


class Shard:
    """Reads a packed shard; ``shard[i]`` touches one place of each level."""

    def __init__(self, codes: bytes):
        if codes[:4] != MAGIC:
            raise ValueError("not a directly addressable code")
        _, n, _, self.size = struct.unpack_from("<BBHq", codes, 4)
        at, self.levels = 16, []
        for k in range(n):
            (entries,) = struct.unpack_from("<q", codes, at)
            at += 8
            chunks = np.frombuffer(codes, np.uint8, entries, at)
            at += entries
            words, marks = (-(-entries // 64), -(-entries // 512)) if k < n - 1 else (0, 0)
            bits = np.frombuffer(codes, np.uint8, 8 * words, at)
            at += 8 * words
            ranks = np.frombuffer(codes, "<u4", marks, at)
            at += 4 * marks
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not len(bits) or not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i >> 9
            before = int(ONES[bits[64 * block : i >> 3]].sum()) + bin(int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).count("1")
            i = int(ranks[block]) + before
        return value

    def all(self) -> np.ndarray:
        """All ids in order."""
        out = None
        for k in range(len(self.levels) - 1, -1, -1):
            chunks, bits, _ = self.levels[k]
            own = chunks.astype(np.uint32)
            if out is not None:
                own[np.unpackbits(bits, bitorder="little")[: len(own)].astype(bool)] |= out << np.uint32(8)
            out = own
        return out


class LibraryEncoder:
    """Whole texts to ids with the tokenizers library, whose BPE model is asked once for each distinct word.

    The library merges inside words only, so a text's ids are those of its words in order. Texts of
    plain characters are split here as the library would; all others go to it whole. The memo is bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.letters = {b: c for c, b in byte_letters().items()}
        self.pieces = Cache(self.piece_ids, 1 << 20, MEMO_BYTES)

    def piece_ids(self, piece: str) -> bytes:
        """Ids of a stretch between white space: the model's for a word, those of its words for any other."""
        words = [piece] if piece.isalpha() else SPLIT.findall(piece)
        if len(words) > 1:
            return b"".join(map(self.pieces.__getitem__, words))
        word = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self.text_ids(t) if t else b"" for t in texts]

    def text_ids(self, text: str) -> bytes:
        """One text at a time: what the library makes of a text is many times its size."""
        if "<|" in text or not PLAIN.fullmatch(text):
            return array("I", self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()
        return b"".join(map(self.pieces.__getitem__, plain_forms(text)))


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


SHARDS = "part int, shard int, doc_ids array<bigint>, n_tokens array<bigint>, before bigint, tokens bigint, codes binary"


def write_tokens(df: DataFrame, path: str, *, text: str = "text", id_column: str = "doc_id", end_id: int | None = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode whole texts and write shards in ascending order of the id; the written table.

    Rows are range-partitioned by (id, hash of the text), so that a single id with very many rows is
    dealt out too. Null ids come first; rows with equal ids are in order of the text's hash. A null
    text has no ids but the end id. A very long text is encoded whole in its row's task and goes on over as many
    shards as it fills; further columns are not read. An empty table gives an empty one.
    """
    small_batches(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h").select("id", "text")
    last = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, shard = encoder(path), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        held: list[bytes] = []
        size = before = 0

        def full() -> pa.RecordBatch:
            codes = pack(np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(h) // 4 for h in held]], pa.list_(pa.int64())), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([codes], pa.binary()),
            ], names=["part", "shard", "doc_ids", "n_tokens", "before", "tokens", "codes"])

        for batch in slices(batches, "text", SLICE_BYTES):
            for i, e in zip(batch.column("id").to_pylist(), own.encode(batch.column("text").to_pylist()), strict=True):
                ids.append(i)
                held.append(e + last)
                size += len(held[-1]) // 4
                if size >= shard_tokens:
                    yield full()
                    ids, held, size, before, shard = [], [], 0, before + size, shard + 1
        if ids:
            yield full()

    return materialize(rows.mapInArrow(run, SHARDS), "tokens")


def with_starts(shards: DataFrame) -> DataFrame:
    """Shards with start, the number of ids in all shards before them.

    Totals by part come to the driver; parts are as many as shuffle partitions.
    """
    totals = {r[0]: r[1] for r in shards.groupBy("part").agg(F.sum("tokens")).collect()}
    bases, at = [], 0
    for part in sorted(totals):
        bases.append((part, at))
        at += totals[part]
    base = listed(shards.sparkSession, bases, "part int, base long")
    return shards.join(base, "part").withColumn("start", F.col("base") + F.col("before"))


def read_documents(shards: DataFrame) -> DataFrame:
    """By document, read back from the shards: doc_id, start, n_tokens and token_ids (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids, counts = Shard(row["codes"]).all().astype("<u4"), row["n_tokens"]
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                    pa.array([ids[e - n : e].tobytes() for e, n in zip(ends, counts, strict=True)], pa.binary()),
                ], names=["doc_id", "start", "n_tokens", "token_ids"])

    return with_starts(shards).select("doc_ids", "n_tokens", "start", "codes").mapInArrow(run, "doc_id long, start long, n_tokens long, token_ids binary")


def stored_digests(shards: DataFrame) -> DataFrame:
    """By document, from the shards: doc_id, start, n_tokens, ids_crc32; the ids themselves stay on the executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids, counts = Shard(row["codes"]).all().astype("<u4"), row["n_tokens"]
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                    pa.array([zlib.crc32(ids[e - n : e]) for e, n in zip(ends, counts, strict=True)], pa.int64()),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return with_starts(shards).select("doc_ids", "n_tokens", "start", "codes").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
