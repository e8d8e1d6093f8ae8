"""Language ID: averaged hashed subword embeddings and a linear softmax.

A text's subwords are the 3- and 4-byte grams of its lower-cased UTF-8 form, with ASCII digits,
punctuation and white space folded to one space. Each gram hashes to a row of an embedding
matrix; the mean row goes through a linear softmax. Both are trained by stochastic gradient
descent in numpy. As mean and classifier are linear, the trained model is stored as one matrix of
logits by hash row, so that scoring is one gather and one segmented sum.

Rejection is calibrated: a temperature is fitted on a held-out fifth of the training sample, and
a text is rejected if its calibrated probability is under the least threshold at which the
held-out part's accepted texts reach ``precision`` (0.5 at least), or if it is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hands_memory_back, hash_share, slices, small_batches, without

LETTER = re.compile(r"[^\W\d_]")  # letters, and a few other signs of number
FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
GAP = b"    "


@dataclass
class LanguageModel:
    labels: list[str]
    logits: np.ndarray  # (buckets, languages), float32
    bias: np.ndarray
    temperature: float
    threshold: float
    calibrated: bool = True  # False: too few texts to hold any back; the temperature is 1 and the threshold 0.5


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in LETTER.finditer(text))


def folded(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(FOLD).split()) + b" "


def gram_rows(data: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash rows of the 3- and 4-byte grams that start at each byte but the last four."""
    v = data.astype(np.uint32)
    g3 = v[:-4] | v[1:-3] << np.uint32(8) | v[2:-2] << np.uint32(16)
    g4 = g3 | v[3:-1] << np.uint32(24)
    shift = np.uint32(32 - bits)
    return (g3 * np.uint32(2654435761)) >> shift, (g4 * np.uint32(2246822519) + np.uint32(374761393)) >> shift


def sums(texts: list[bytes], logits: np.ndarray, bits: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """By text: the sum of its grams' logits, and how many grams it has. Long texts go in pieces."""
    total, count = np.zeros((len(texts), logits.shape[1])), np.zeros(len(texts))
    parts, owners, starts, size = [], [], [], 0

    def flush():
        nonlocal parts, owners, starts, size
        if not parts:
            return
        data = np.frombuffer(b"".join(parts) + GAP, np.uint8)
        a, b = gram_rows(data, bits)
        each = np.add.reduceat(logits[a] + logits[b], starts, axis=0, dtype=np.float64)
        own = np.array(owners) >= 0
        np.add.at(total, np.array(owners)[own], each[own])
        np.add.at(count, np.array(owners)[own], 2.0 * np.diff([*starts, len(a)])[own])
        parts, owners, starts, size = [], [], [], 0

    for i, text in enumerate(texts):
        for at in range(0, len(text), most):
            piece, ahead = text[at : at + most], text[at + most : at + most + len(GAP)]
            # Blanks, or the text's next bytes, end the last grams; the grams that begin there count for nobody.
            owners += [i, -1]
            starts += [size, size + len(piece)]
            parts.append(piece + ahead.ljust(len(GAP)))
            size += len(piece) + len(GAP)
            if size >= most:
                flush()
    flush()
    return total, np.maximum(count, 1)


def scores(texts: list[str], model: LanguageModel) -> np.ndarray:
    """Calibrated probabilities, (texts, languages)."""
    bits = int(model.logits.shape[0]).bit_length() - 1
    total, count = sums([folded(t) for t in texts], model.logits, bits)
    z = (total / count[:, None] + model.bias) / model.temperature
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], *, bits: int = 16, dim: int = 16, epochs: int = 6, rate: float = 4.0, precision: float = 0.995, seed: int = 5) -> LanguageModel | None:
    """Train on the driver's bounded sample; None without any text that has a letter."""
    pairs = [(t, y) for t, y in zip(texts, langs, strict=True) if has_letter(t)]
    if not pairs:
        return None
    labels = sorted({y for _, y in pairs})
    at = {y: i for i, y in enumerate(labels)}
    grams, y = [], np.array([at[b] for _, b in pairs])
    for t, _ in pairs:
        a, b = gram_rows(np.frombuffer(folded(t) + GAP, np.uint8), bits)
        rows, n = np.unique(np.concatenate([a, b]), return_counts=True)
        grams.append((rows, (n / n.sum()).astype(np.float32)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    check, train = order[: len(y) // 5], order[len(y) // 5 :]
    share = np.bincount(y[train], minlength=len(labels))
    weight = len(train) / (len(labels) * np.maximum(share, 1))  # each language counts alike
    emb = rng.normal(0, 0.5, (1 << bits, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    step, steps = 0, max(1, epochs * len(train))
    for _ in range(epochs):
        for i in rng.permutation(train):
            rows, w = grams[i]
            lr = rate * (1 - step / steps)
            step += 1
            e = emb[rows]
            h = w @ e
            z = h @ out + bias
            p = np.exp(z - z.max())
            d = p / p.sum()
            d[y[i]] -= 1
            d *= min(4.0, weight[y[i]])
            back = out @ d
            out -= lr * 0.25 * np.outer(h, d)
            bias -= lr * 0.01 * d
            emb[rows] = e - lr * np.outer(w, back)
    model = LanguageModel(labels, emb @ out, bias, 1.0, 0.5, len(check) > 0)
    if not model.calibrated:
        return model
    raw = np.log(np.maximum(scores([pairs[i][0] for i in check], model), 1e-12))
    truth = y[check]

    def loss(t: float) -> float:
        z = raw / t
        z -= z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(axis=1))).mean())

    model.temperature = min(np.geomspace(0.05, 20, 61), key=loss)
    p = scores([pairs[i][0] for i in check], model)
    best, right = p.max(axis=1), p.argmax(axis=1) == truth
    down = np.argsort(-best, kind="stable")
    good = np.cumsum(right[down]) / np.arange(1, len(down) + 1) >= precision
    reach = np.flatnonzero(good)
    model.threshold = max(0.5, float(best[down[reach[-1]]]) if len(reach) and reach[-1] + 1 < len(down) else 0.5)
    return model


@hands_memory_back
def train_language_model(df: DataFrame, *, text: str = "text", lang: str = "lang", id_column: str = "doc_id", where: Column | None = None, per_language: int = 1500, bytes_per_language: int = 24 << 20, most_bytes: int = 192 << 20, most_languages: int = 500, **settings) -> LanguageModel | None:
    """Fit on at most ``per_language`` labelled rows of each language, chosen by a hash of id and text.

    The sample's whole texts come to the driver; where a language's rows are long, fewer are taken, so that
    they have ``bytes_per_language`` at most, and all languages ``most_bytes``; texts of over an eighth of a language's
    share are not learned from. Of more than ``most_languages``
    the commonest are learned. Repeated rows teach once, rows without text or language nothing; an empty
    table gives None.
    """
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id_column).isNotNull())
    known = known.where(where) if where is not None else known
    counts = known.groupBy(lang).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text).cast("long")).alias("size")).orderBy(F.desc("n"), lang).limit(most_languages).collect()
    if not counts:
        return None
    share = min(bytes_per_language, most_bytes // len(counts))
    chosen = F.lit(False)
    for name, n, size in sorted(counts):
        chosen = chosen | ((F.col(lang) == name) & hash_share([id_column, text], n, min(per_language, n * share // max(1, size))))
    rows = known.where(chosen & (F.octet_length(text) <= share // 8)).select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).dropDuplicates()
    # What an id with very many rows brings beyond the bounds goes; each task drops most of it by itself.
    by = Window.partitionBy("lang").orderBy("_by", "id", "text")
    rows = rows.withColumn("_by", F.xxhash64("id", "text")).withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= per_language)
    rows = rows.withColumn("_size", F.sum(F.octet_length("text").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_size") <= share)
    sample = sorted(rows.select("id", "text", "lang").collect(), key=lambda r: (r[0], r[2], r[1]))
    return fit([r[1] for r in sample], [r[2] for r in sample], **settings)


def predict_language(df: DataFrame, model: LanguageModel | None, *, text: str = "text") -> DataFrame:
    """Every row of ``df`` with lang_pred, lang_score (0 to 1) and lang_accepted.

    Null texts and texts without a letter get ``und``, 0.0, false; so does every row if the model is
    None. Rows are judged one by one and whole, repeated ones alike; a very long text is folded in pieces
    in its row's task. Further columns pass through; columns of these three names are replaced.
    """
    small_batches(df.sparkSession)
    df = without(df, "lang_pred", "lang_score", "lang_accepted")
    schema = df.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score"), F.lit(True).alias("lang_accepted")).schema
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, text):
            texts = batch.column(text).to_pylist()
            known = [i for i, t in enumerate(texts) if own and has_letter(t)]
            pred, score, ok = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            if known:
                p = scores([texts[i] for i in known], own)
                for i, k, s in zip(known, p.argmax(axis=1), p.max(axis=1), strict=True):
                    pred[i], score[i], ok[i] = own.labels[k], float(s), bool(s >= own.threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], names=[*batch.schema.names, "lang_pred", "lang_score", "lang_accepted"])

    return df.mapInArrow(run, schema)
