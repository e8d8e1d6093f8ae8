"""Importance resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tessera.llm import resample
from tessera.llm.common import Cache


def features(text: str | None) -> tuple[int, list[str]]:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % 10_000


def expected(docs: list[tuple], target: list) -> list[tuple]:
    own = [(i, *features(t)) for i, t in docs]
    counts = [Counter(map(bucket, f)) for _, _, f in own]
    s, t = sum(counts, Counter()), Counter(bucket(f) for x in target for f in features(x)[1])
    n, m = sum(s.values()), sum(t.values())
    gains = [math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000)))) for b in range(10_000)]
    rows = []
    for (i, words, f), c in zip(own, counts, strict=True):
        weight = sum(k * gains[b] for b, k in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    known = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    most = 5 * len(known) // 100
    return [*((*r[:4], k + 1 if k < most else None) for k, r in enumerate(known)), *((*r[:4], None) for r in rows if r[4] < 20)]


def got(docs, target, **settings) -> list[tuple]:
    return sorted(map(tuple, resample.resample(docs, target, **settings).collect()), key=str)


@given(st.lists(st.binary(min_size=1, max_size=9).map(lambda b: re.sub(rb"[^0-9a-z]", b"x", b)) | st.integers(60, 5000).map(lambda n: b"y" * n), min_size=2, max_size=6))
@settings(max_examples=60, deadline=None)
def test_sums_of_joined_words(words):
    shift, v = resample.CrcShift(), np.frombuffer(b"".join(map(resample.word_sums, words)), "<u4").reshape(-1, 3)
    two = shift(v[:-1, 0], v[1:, 2]) ^ v[1:, 1]
    assert two.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:], strict=False)]


def test_texts_in_pieces(monkeypatch):
    text = "Aa b2 çé-x " * 50 + "z" * 300 + " end"
    memo, shift = Cache(resample.word_sums, 1000), resample.CrcShift()
    for piece in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(resample, "PIECE", piece)
        counts, n = resample.feature_counts(text, memo, shift, 10_000)
        words, own = features(text)
        assert n == words and dict(Counter(map(bucket, own))) == {i: c for i, c in enumerate(counts.tolist()) if c}


def test_lists_are_packed_without_loss():
    rng, codec = random.Random(5), resample._zstd()
    for _ in range(50):
        lists = [sorted(rng.sample(range(4096), rng.choice([0, 1, 3, 500, 4096]))) for _ in range(resample.WIDTH)]
        counts = [[rng.choice([1, 2, 254, 255, 10**7]) for _ in x] for x in lists]
        flat = lambda x: np.array([v for y in x for v in y], np.int64)
        data, size = resample.pack(np.array([len(x) for x in lists]), flat(lists), flat(counts), codec)
        assert [(k, d.tolist(), n.tolist()) for k, d, n in resample.unpack(data, size, codec)] == [(k, d, n) for k, (d, n) in enumerate(zip(lists, counts, strict=True)) if d]


def test_documents(documents, spark, sf_dir):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = got(documents, target)
    assert rows == sorted(expected([(r["doc_id"], r["text"]) for r in documents.collect()], [r["text"] for r in target.collect()]), key=str)
    assert sum(r[4] is not None for r in rows) > 0


@pytest.mark.parametrize("aim", ["odd", "none"])
def test_odd_rows(spark, odd_docs, no_docs, aim):
    """Null and repeated ids, null, empty and long texts, ties, further columns, an empty target or corpus."""
    more = odd_docs.unionByName(spark.createDataFrame([(i, "so " * 25 + str((i or 0) % 7), None, None, 1) for i in [*range(60), 3, None]], odd_docs.schema))
    more = more.withColumns({c: F.lit(1) for c in ("group", "block", "words", "weight", "rank", "_id", "id", "score")})
    target = odd_docs if aim == "odd" else no_docs
    assert got(more, target) == sorted(expected([(r["doc_id"], r["text"]) for r in more.collect()], [r["text"] for r in target.collect()]), key=str)
    assert got(no_docs, target) == []


def test_small_blocks_and_early_flushes_change_nothing(documents, monkeypatch):
    """Blocks of few postings; many blocks a task, given out before its end."""
    want = got(documents, documents)
    assert want == sorted(expected([(r["doc_id"], r["text"]) for r in documents.collect()], [r["text"] for r in documents.collect()]), key=str)
    for name, value in (("MOST_POSTINGS", 900), ("MOST_BLOCKS", 2)):
        monkeypatch.setattr(resample, name, value)
    assert got(documents, documents) == want


def test_the_target_draws_its_like(spark):
    rows = [(i, " ".join(f"{'law' if i % 10 == 0 else 'zoo'}{(i * 31 + k * 7) % 50}" for k in range(60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    drawn = [r[0] for r in got(docs, docs.where("doc_id % 10 = 0 and doc_id > 200")) if r[4]]
    assert len(drawn) == 20 and sum(i % 10 == 0 for i in drawn) == 20
