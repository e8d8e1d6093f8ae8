"""Toxicity: a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words (letters and digits) and their four- and
five-letter beginnings, hashed to 2**22 values. A term gets parameters if its presence tells something about
the label in the training sample, or if it does so together with another term: of the commonest terms,
those count whose covariance with any other differs between the labels. They have a weight and a factor vector; a text's score
is the logistic of ``w0 + sum w_i + sum_{i<j} <v_i, v_j>`` over its distinct terms, so that a pair
such as an insult with a group mention counts beyond the sum of its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cache, bounded, hands_memory_back, hash_share, slices, small_batches, without

WORD = re.compile(r"[^\W_]+")
BITS = 22
MOST_WORDS, MEMO_BYTES = 200_000, 40 << 20  # memo of a worker


def word_terms(word: str) -> bytes:
    """The hashed terms of one lower-cased word, as little-endian unsigned 32-bit integers."""
    terms = {f"w{word}"}
    terms.update(f"{n}{word[:n]}" for n in (4, 5) if len(word) > n)
    return np.array(sorted(xxhash.xxh32_intdigest(t) >> (32 - BITS) for t in terms), "<u4").tobytes()


@dataclass
class ToxicityModel:
    terms: np.ndarray  # sorted hashes that have parameters
    w0: float
    w: np.ndarray
    v: np.ndarray


def distinct_terms(text: str | None, memo: dict) -> np.ndarray:
    """Sorted distinct values that ``memo`` has for the text's distinct words; none for a null text."""
    return np.unique(np.frombuffer(b"".join(map(memo.__getitem__, set(WORD.findall(text.lower())))), "<u4")) if text else np.empty(0, "<u4")


def margin(model: ToxicityModel, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The machine's raw output and its factor sums for texts whose term positions are ids[starts[i]:starts[i+1]]."""
    n = len(starts) - 1
    raw, sums = np.full(n, model.w0), np.zeros((n, model.v.shape[1]))
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        at, v = starts[full], model.v[ids]
        sums[full] = np.add.reduceat(v, at, axis=0)
        raw[full] += np.add.reduceat(model.w[ids], at) + 0.5 * ((sums[full] ** 2).sum(axis=1) - np.add.reduceat((v**2).sum(axis=1), at))
    return raw, sums


def paired(own: list[np.ndarray], y: np.ndarray, share: np.ndarray) -> np.ndarray:
    """By term: the largest z of the difference between its covariances with another term under the two labels.

    own: positions of each row's terms; share: the share of all rows that hold a term. Rows are counted in blocks.
    """
    k = len(share)
    both = [np.zeros((k, k), np.float32), np.zeros((k, k), np.float32)]
    held = [np.zeros(k), np.zeros(k)]
    for label in (0, 1):
        rows = np.flatnonzero(y == label)
        for at in range(0, len(rows), 1024):
            part = [own[i] for i in rows[at : at + 1024]]
            block = np.zeros((len(part), k), np.float32)
            block[np.repeat(np.arange(len(part)), [len(p) for p in part]), np.concatenate(part)] = 1
            both[label] += block.T @ block
            held[label] += block.sum(axis=0)
    n = [(y == 0).sum(), (y == 1).sum()]
    cov = [both[c] / n[c] - np.outer(held[c] / n[c], held[c] / n[c]) for c in (0, 1)]
    spread = np.sqrt(share * (1 - share))
    z = np.abs(cov[1] - cov[0]) / (np.outer(spread, spread) * np.sqrt(1 / n[0] + 1 / n[1]))
    z[both[0] + both[1] < 10] = 0  # too few rows hold both
    np.fill_diagonal(z, 0)
    return z.max(axis=1, initial=0)


def fit(features: list[np.ndarray], labels: np.ndarray, *, most_terms: int = 8192, least_z: float = 3.0, most_common: int = 2048, least_pair_z: float = 6.0, most_paired: int = 512, factors: int = 8, epochs: int = 15, batch: int = 256, rate: float = 0.1, decay: float = 1e-4, seed: int = 1) -> ToxicityModel:
    """AdaGrad on the logistic loss. Without rows of both labels the model is the prior alone.

    Terms get parameters if they tell by themselves (``least_z``; the ``most_terms`` strongest), or, among the
    ``most_common`` ones, in a pair (``least_pair_z``; the ``most_paired`` strongest).
    """
    y = np.asarray(labels, float)
    n1, n0 = y.sum(), len(y) - y.sum()
    prior = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not n1 or not n0:
        return ToxicityModel(np.empty(0, np.uint32), prior, np.empty(0), np.empty((0, factors)))
    size = 1 << BITS
    every = np.concatenate([*features, np.empty(0, np.uint32)])
    df1 = np.bincount(np.concatenate([np.empty(0, np.uint32), *(f for f, t in zip(features, y, strict=True) if t)]), minlength=size)
    df = np.bincount(every, minlength=size)
    share = (df + 0.5) / (len(y) + 1)
    z = (df1 / n1 - (df - df1) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    z[df < 3] = 0
    terms = np.flatnonzero(np.abs(z) >= least_z)
    terms = terms[np.argsort(-np.abs(z[terms]), kind="stable")][:most_terms]
    place = np.full(size, -1, np.int32)
    common = np.argsort(-share * (1 - share) * (df >= 3), kind="stable")[:most_common]
    common = common[df[common] >= 3]
    place[common] = np.arange(len(common))
    pair_z = paired([(p := place[f])[p >= 0] for f in features], y, share[common])
    strong = np.flatnonzero(pair_z >= least_pair_z)
    strong = strong[np.argsort(-pair_z[strong], kind="stable")][:most_paired]
    place[common] = -1
    terms = np.union1d(terms, common[strong]).astype(np.uint32)
    place[terms] = np.arange(len(terms))
    own = [(p := place[f])[p >= 0] for f in features]
    rng = np.random.default_rng(seed)
    model = ToxicityModel(terms, prior, np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), factors)))
    g0, gw, gv = 1e-8, np.full(len(terms), 1e-8), np.full((len(terms), factors), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            starts = np.concatenate([[0], np.cumsum([len(own[i]) for i in rows])])
            ids = np.concatenate([own[i] for i in rows]).astype(np.int64)
            raw, sums = margin(model, ids, starts)
            d = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) / len(rows)
            g = d.sum()
            g0 += g * g
            model.w0 -= rate * g / np.sqrt(g0)
            each = np.repeat(d, np.diff(starts))
            grad = np.bincount(ids, each, minlength=len(terms)) + decay * model.w
            gw += grad**2
            model.w -= rate * grad / np.sqrt(gw)
            back = each[:, None] * (np.repeat(sums, np.diff(starts), axis=0) - model.v[ids])
            grad = np.stack([np.bincount(ids, back[:, k], minlength=len(terms)) for k in range(factors)], axis=1) + decay * model.v
            gv += grad**2
            model.v -= rate * 0.3 * grad / np.sqrt(gv)
    return model


@hands_memory_back
def train_toxicity(df: DataFrame, labels: DataFrame, *, text: str = "text", id_column: str = "doc_id", label: str = "toxic", where: Column | None = None, most_rows: int = 20_000, most_bytes: int = 160 << 20, **settings) -> ToxicityModel:
    """Fit on at most ``most_rows`` labelled rows with ``most_bytes`` of terms, chosen by a hash of the id and then of id and terms.

    Executors turn the sample's whole texts into distinct term hashes; these come to the driver.
    Rows with a null id or label teach nothing. An id that has several labels counts as 1 if any is; one that
    has very many rows is cut at the same bounds. Empty tables give the prior.
    """
    small_batches(df.sparkSession)
    known = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull())
    known = (known.where(where) if where is not None else known).groupBy(id_column).agg(F.max(label).alias("_label"))
    chosen = known.where(hash_share(id_column, known.count(), most_rows))  # bounded, so it may be broadcast
    rows = df.select(F.col(id_column), F.col(text).alias("_text")).join(F.broadcast(chosen), id_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Cache(word_terms, MOST_WORDS, MEMO_BYTES)
        for batch in slices(batches, "_text"):
            terms = [distinct_terms(t, memo).tobytes() for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.binary()), batch.column(2).cast(pa.int32())], names=["id", "terms", "label"])

    terms = rows.mapInArrow(run, "id long, terms binary, label int")
    found = bounded(terms, ["id", "terms"], F.octet_length("terms"), most_rows, most_bytes).toArrow().to_pydict()
    order = sorted(range(len(found["id"])), key=lambda i: (found["id"][i], found["terms"][i]))
    return fit([np.frombuffer(found["terms"][i], "<u4") for i in order], np.array([found["label"][i] for i in order]) > 0, **settings)


def score_toxicity(df: DataFrame, model: ToxicityModel, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Every row of ``df`` with toxicity (0 to 1) and is_toxic (1 from ``threshold`` on).

    Null and empty texts have no terms and get the prior. Rows are scored one by one and whole: repeated rows
    score alike, a very long text is one row's work in a task, an empty table stays empty. Columns of these two
    names are replaced, further ones pass through.
    """
    small_batches(df.sparkSession)
    df = without(df, "toxicity", "is_toxic")
    schema = df.select("*", F.lit(0.0).alias("toxicity"), F.lit(0).alias("is_toxic")).schema
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        place = {int(t): i for i, t in enumerate(own.terms)}

        def places(word: str) -> bytes:
            return np.array([p for t in np.frombuffer(word_terms(word), "<u4") if (p := place.get(int(t))) is not None], "<u4").tobytes()

        memo = Cache(places, MOST_WORDS, MEMO_BYTES)
        for batch in slices(batches, text):
            each = [distinct_terms(t, memo) for t in batch.column(text).to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64)
            raw, _ = margin(own, np.concatenate(each).astype(np.int64), starts)
            p = 1 / (1 + np.exp(-np.clip(raw, -60, 60)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, "toxicity", "is_toxic"])

    return df.mapInArrow(run, schema)
