"""Quality classifier: co-training of two views.

The content view sees a text's words: hashed lower-cased letter runs, symbol runs, upper-case marks, and
how far words repeat. The page view sees metadata alone: source, language, length, and how the page is
laid out (lines, their lengths, repeated lines, shares of symbols, capitals, digits and blanks). Each is
a logistic model. In every round each view labels the unlabelled texts it is surest of, and the other
view trains on them too. Then both are calibrated on a quarter of the labelled texts of each label that
neither trained on (Platt scaling), and a document's score is the logistic of the mean calibrated log-odds, weighted
by how well each view ranks that part.
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

BITS = 16
MOST_WORDS, MEMO_BYTES = 200_000, 40 << 20  # memo of a worker
RUN = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
SLOTS = 3  # hashed values of a word; 0 stands for none


def hashed(text: str) -> int:
    return 1 + xxhash.xxh32_intdigest(text) % ((1 << BITS) - 1)


def word_values(word: str) -> bytes:
    """Three values of a word: its letters, its symbols, its casing."""
    letters = "".join(c for c in word if c.isalnum())
    symbols = "".join(c for c in word if not c.isalnum())
    case = "upper" if len(letters) > 1 and letters.isupper() else "other" if letters and not letters[1:].islower() and len(letters) > 1 else ""
    return np.array([hashed("w" + letters.lower()) if letters else 0, hashed("s" + symbols) if symbols else 0, hashed("c" + case) if case else 0], "<u4").tobytes()


def binned(name: str, value: float, edges: list[float]) -> int:
    return hashed(f"{name}{int(np.searchsorted(edges, value))}")


SHARES = [0.0, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95]
SIZES = [0, 1, 3, 10, 30, 60, 100, 200, 400, 800, 1600, 3200, 6400, 12800, 25600, 100000]


def content_view(text: str, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashed values and weights: words by their share of the text, the rest 1."""
    words = text.split()
    v = np.frombuffer(b"".join(map(memo.__getitem__, words)), "<u4").reshape(-1, SLOTS)
    used, n = np.unique(v[v > 0], return_counts=True)
    first = v[:, 0]
    repeats = float((first[1:] == first[:-1]).mean()) if len(first) > 1 else 0.0
    variety = len(np.unique(first)) / len(first) if len(first) else 1.0
    runs = float((v[:, 1] > 0).mean()) if len(first) else 0.0
    extra = [binned("repeats", repeats, SHARES), binned("variety", variety, SHARES), binned("marked", runs, SHARES), binned("words", len(words), SIZES)]
    return np.concatenate([used, extra]).astype(np.int64), np.concatenate([np.sqrt(n / max(1, len(words))), np.ones(len(extra))])


def page_view(text: str, lang: str | None, source: str | None) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(data))
    kinds = np.bincount(KIND[data], minlength=5) / n
    lines = text.split("\n")
    sizes = [len(x) for x in lines]
    values = [
        hashed(f"lang{lang}"), hashed(f"source{source}"), binned("chars", len(text), SIZES), binned("lines", len(lines), SIZES),
        binned("line", sum(sizes) / len(sizes), SIZES), binned("longest", max(sizes), SIZES), binned("same", 1 - len(set(lines)) / len(lines), SHARES),
        *(binned(f"kind{i}", k, SHARES) for i, k in enumerate(kinds)),
    ]
    return np.array(values, np.int64), np.ones(len(values))


#: Byte classes: small letters and non-ASCII, capitals, digits, white space, symbols.
KIND = np.array([1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in b" \t\n\r\v\f" else 0 if b >= 128 or 97 <= b <= 122 else 4 for b in range(256)])


@dataclass
class QualityModel:
    weights: list[np.ndarray]  # by view, (1 << BITS) + 1, the last is the bias
    scales: list[tuple[float, float]]  # by view, calibrated log-odds = a * raw + b
    shares: list[float]
    threshold: float
    calibrated: bool = True  # False: too few labels to hold any of a label back; scores rank but are no probabilities


def raw(weights: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One gather and one segmented sum; every row has values."""
    if not rows:
        return np.empty(0)
    starts = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
    return weights[-1] + np.add.reduceat(weights[np.concatenate([i for i, _ in rows])] * np.concatenate([w for _, w in rows]), starts)


def logistic(rows: list, y: np.ndarray, *, epochs: int = 12, rate: float = 0.1, decay: float = 1e-5, batch: int = 16, seed: int = 3) -> np.ndarray:
    """AdaGrad by small batches, over the values that the rows have; all others keep the weight 0."""
    own, places = np.unique(np.concatenate([i for i, _ in rows]), return_inverse=True)
    ends = np.cumsum([len(i) for i, _ in rows])
    begin, sizes, x = ends - [len(i) for i, _ in rows], np.array([len(i) for i, _ in rows]), np.concatenate([v for _, v in rows])
    w, g, bias, gb = np.zeros(len(own)), np.full(len(own), 1e-6), 0.0, 1e-6
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            n = sizes[part]
            starts = np.cumsum(n) - n
            flat = np.repeat(begin[part] - starts, n) + np.arange(n.sum())
            ids, v = places[flat], x[flat]
            d = 1 / (1 + np.exp(-np.clip(bias + np.add.reduceat(w[ids] * v, starts), -30, 30))) - y[part]
            used, inverse = np.unique(ids, return_inverse=True)
            step = np.bincount(inverse, np.repeat(d, n) * v) + decay * w[used]
            g[used] += step**2
            w[used] -= rate * step / np.sqrt(g[used])
            gb += d.sum() ** 2
            bias -= rate * d.sum() / np.sqrt(gb)
    out = np.zeros((1 << BITS) + 1)
    out[own], out[-1] = w, bias
    return out


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log-odds by Newton steps, with Platt's smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d, h = p - t, np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(d * z).sum() + 1e-3 * (a - 1), d.sum()])
        step = np.linalg.solve(np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]]), grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def ranking(z: np.ndarray, y: np.ndarray) -> float:
    """Share of pairs of a good and a bad text in the right order; ties count half."""
    good, bad = np.sort(z[y > 0]), z[y == 0]
    if not len(good) or not len(bad):
        return 0.5
    return float((len(good) - (np.searchsorted(good, bad, "left") + np.searchsorted(good, bad, "right")) / 2).mean() / len(good))


def fit(views: list[list], y: np.ndarray, pool: list[list], *, rounds: int = 3, share: float = 0.1, sure: float = 0.95, threshold: float = 0.5, seed: int = 3) -> QualityModel | None:
    """views: the labelled rows by view; pool: the unlabelled rows by view. None without rows of both labels."""
    y = np.asarray(y, float)
    if not y.any() or y.all():
        return None
    order = np.random.default_rng(seed).permutation(len(y))
    check = np.concatenate([(own := order[y[order] == label])[: len(own) // 4] for label in (0, 1)])
    train = np.setdiff1d(order, check)
    calibrated = len(np.unique(y[check])) == 2
    given: list[dict[int, float]] = [{}, {}]  # pseudo-labels of the pool that each view trains on
    weights: list[np.ndarray] = []
    for turn in range(rounds + 1):
        weights = [logistic([*(views[v][i] for i in train), *(pool[v][i] for i in given[v])], np.array([*y[train], *given[v].values()]), seed=seed) for v in (0, 1)]
        if turn == rounds or not pool[0]:
            break
        for v in (0, 1):
            a, b = platt(raw(weights[v], [views[v][i] for i in train]), y[train])
            p = 1 / (1 + np.exp(-np.clip(a * raw(weights[v], pool[v]) + b, -30, 30)))
            most = max(1, int(share * len(p)))
            for sign, rate in ((1, y[train].mean()), (0, 1 - y[train].mean())):  # labels are added in the proportion of the training rows
                conf = p.copy() if sign else 1 - p
                conf[list(given[1 - v])] = -1.0  # each round gives new rows
                for i in np.argsort(-conf, kind="stable")[: max(1, int(most * rate))]:
                    if conf[i] >= sure:
                        given[1 - v][int(i)] = float(sign)
    if not calibrated:
        return QualityModel(weights, [(1.0, 0.0)] * 2, [0.5, 0.5], threshold, False)
    z = [raw(weights[v], [views[v][i] for i in check]) for v in (0, 1)]
    skill = [max(0.02, ranking(z[v], y[check]) - 0.5) for v in (0, 1)]
    return QualityModel(weights, [platt(z[v], y[check]) for v in (0, 1)], [s / sum(skill) for s in skill], threshold)


def probabilities(model: QualityModel, views: list[list]) -> np.ndarray:
    """By row: the combined score and each view's own."""
    odds = np.stack([a * raw(w, rows) + b for w, (a, b), rows in zip(model.weights, model.scales, views, strict=True)])
    odds = np.vstack([np.asarray(model.shares) @ odds, odds])
    return (1 / (1 + np.exp(-np.clip(odds, -40, 40)))).T


def _views(batch: pa.RecordBatch, names: list[str], memo: dict) -> list[list]:
    texts = [t or "" for t in batch.column(names[0]).to_pylist()]
    langs, sources = (batch.column(c).to_pylist() for c in names[1:])
    return [[content_view(t, memo) for t in texts], [page_view(t, a, s) for t, a, s in zip(texts, langs, sources, strict=True)]]


@hands_memory_back
def train_quality(df: DataFrame, labels: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", id_column: str = "doc_id", label: str = "quality", where: Column | None = None, most_rows: int = 6000, most_pool: int = 4000, most_bytes: int = 160 << 20, **settings) -> QualityModel | None:
    """Fit on at most ``most_rows`` labelled and ``most_pool`` unlabelled rows with ``most_bytes`` of values each, chosen by a hash of the id and then of the row.

    Executors turn the chosen whole texts into both views' values; these come to the driver. As an
    unlabelled row is known only there, ``most_pool + most_rows`` rows are drawn for the pool, of which the
    first ``most_pool`` without a chosen label are it. Rows with a null id or label teach nothing; an id
    with several labels counts by the lowest. None if the labelled rows are not of both kinds.
    """
    small_batches(df.sparkSession)
    known = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull())
    known = (known.where(where) if where is not None else known).groupBy(id_column).agg(F.min(label).cast("int").alias("_label"))
    chosen = known.where(hash_share(id_column, known.count(), most_rows))
    rows = df.where(F.col(id_column).isNotNull()).select(id_column, F.col(text).alias("_text"), F.col(lang).alias("_lang"), F.col(source).alias("_source"))
    part = rows.where(hash_share([id_column, "_text"], rows.count(), most_pool + most_rows)).withColumn("_label", F.lit(None).cast("int"))
    named = rows.join(F.broadcast(chosen), id_column)  # chosen is bounded in ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Cache(word_values, MOST_WORDS, MEMO_BYTES)
        for batch in slices(batches, "_text"):
            content, page = _views(batch, ["_text", "_lang", "_source"], memo)
            packed = lambda rows: [i.astype("<u4").tobytes() + w.astype("<f4").tobytes() for i, w in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column("_label"), pa.array(packed(content), pa.binary()), pa.array(packed(page), pa.binary())], names=["id", "label", "content", "page"])

    def opened(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        half = len(data) // 2
        return np.frombuffer(data[:half], "<u4").astype(np.int64), np.frombuffer(data[half:], "<f4").astype(float)

    size = F.octet_length("content") + F.octet_length("page")
    found = []
    for rows, most in ((named, most_rows), (part, most_pool + most_rows)):
        views = rows.mapInArrow(run, "id long, label int, content binary, page binary")
        found += bounded(views, ["id", "content", "page"], size, most, most_bytes).toArrow().to_pylist()
    found.sort(key=lambda r: (r["id"], r["label"] is None, r["content"], r["page"]))
    labelled = [r for r in found if r["label"] is not None]
    ids = {r["id"] for r in labelled}
    pool = [r for r in found if r["label"] is None and r["id"] not in ids]
    pool = sorted(pool, key=lambda r: xxhash.xxh64_intdigest(str(r["id"])))[:most_pool]
    return fit([[opened(r[v]) for r in labelled] for v in ("content", "page")], np.array([r["label"] for r in labelled]), [[opened(r[v]) for r in pool] for v in ("content", "page")], **settings)


def score_quality(df: DataFrame, model: QualityModel | None, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Every row of ``df`` with quality_score (0 to 1), content_score, page_score and quality_kept.

    A null text counts as empty, a null language or source as a value of its own. Rows are scored one by
    one and whole, so repeated rows score alike and a very long text is one row's work in a task. Without a
    model every row has the scores 0.5 and is kept. Columns of these four names are replaced, further ones pass.
    """
    names = ["quality_score", "content_score", "page_score", "quality_kept"]
    small_batches(df.sparkSession)
    df = without(df, *names)
    schema = df.select("*", *(F.lit(0.0).alias(c) for c in names[:3]), F.lit(True).alias(names[3])).schema
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memo = shared.value, Cache(word_values, MOST_WORDS, MEMO_BYTES)
        for batch in slices(batches, text):
            p = probabilities(own, _views(batch, [text, lang, source], memo)) if own else np.full((batch.num_rows, 3), 0.5)
            kept = p[:, 0] >= (own.threshold if own else 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, i]) for i in range(3)), pa.array(kept)], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema)
