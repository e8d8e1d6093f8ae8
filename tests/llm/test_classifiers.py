"""Toxicity, quality and language: learning on planted signals, and odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import langid, quality, toxicity

WORDS = [a + b for a in ("ba", "ke", "mo", "ri", "tu", "so") for b in ("lan", "der", "mis", "tok", "pel", "gar")]


@pytest.mark.parametrize("rule", ["xor", "and"])
def test_factorization_machine_learns_pairs(rule):
    """With XOR neither word tells anything alone: default settings keep both, an additive model can't do it."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(6000):
        a, b = rng.random(2) < 0.5
        noise = rng.integers(100, 130, 5)
        rows.append(np.unique(np.array([*noise, *([1] if a else []), *([2] if b else [])], np.uint32)))
        y.append(int(a != b if rule == "xor" else a and b))

    def accuracy(model) -> float:
        place = {int(t): i for i, t in enumerate(model.terms)}
        ids = [np.array([place[int(t)] for t in r if int(t) in place], np.int64) for r in rows[4500:]]
        raw, _ = toxicity.margin(model, np.concatenate(ids), np.concatenate([[0], np.cumsum([len(i) for i in ids])]))
        return float(((raw > 0) == np.array(y[4500:], bool)).mean())

    model = toxicity.fit(rows[:4500], np.array(y[:4500]), epochs=40)
    place = {int(t): i for i, t in enumerate(model.terms)}
    assert accuracy(model) > 0.99 and abs(model.v[place[1]] @ model.v[place[2]]) > 0.5
    if rule == "xor":
        assert accuracy(toxicity.fit(rows[:4500], np.array(y[:4500]), least_z=0.0, factors=1, rate=0.1, decay=1e9)) < 0.6
        alone = toxicity.fit(rows[:4500], np.array(y[:4500]), most_common=0, epochs=40)
        assert accuracy(alone) < 0.6  # a screen of single terms keeps neither


def test_pair_screen_against_plain_counts():
    rng = np.random.default_rng(6)
    x, y = rng.random((1500, 7)) < 0.4, (rng.random(1500) < 0.3).astype(float)
    share = (x.sum(axis=0) + 0.5) / 1501
    got = toxicity.paired([np.flatnonzero(r) for r in x], y, share)
    z = np.zeros((7, 7))
    for i in range(7):
        for j in range(7):
            if i != j:
                cov = [np.cov(x[y == c][:, i], x[y == c][:, j], bias=True)[0, 1] for c in (0, 1)]
                z[i, j] = abs(cov[1] - cov[0]) / np.sqrt(share[i] * (1 - share[i]) * share[j] * (1 - share[j]) * (1 / (y == 0).sum() + 1 / (y == 1).sum()))
    assert np.allclose(got, z.max(axis=1), rtol=1e-3)


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.ToxicityModel(np.arange(6, dtype=np.uint32), 0.3, rng.normal(size=6), rng.normal(size=(6, 4)))
    for ids in ([0, 2, 5], [1], [], [0, 1, 2, 3, 4, 5]):
        raw, _ = toxicity.margin(m, np.array(ids, np.int64), np.array([0, len(ids)]))
        brute = m.w0 + sum(m.w[i] for i in ids) + sum(m.v[i] @ m.v[j] for a, i in enumerate(ids) for j in ids[a + 1 :])
        assert raw[0] == pytest.approx(brute)


@pytest.fixture(scope="module")
def toxic(spark):
    random.seed(3)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = random.choices(WORDS, k=40) + (["zorgle" + random.choice(["n", "s", "ta"])] if bad else [])
        random.shuffle(words)
        rows.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, int(not bad), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_rows_it_did_not_learn_from(toxic, odd_docs, no_docs):
    docs, labels = toxic
    model = toxicity.train_toxicity(docs, labels, where=F.col("doc_id") % 4 != 2)
    found = toxicity.score_toxicity(docs.where("doc_id % 4 = 2"), model).toPandas()
    assert ((found["doc_id"] % 5 == 0) == (found["is_toxic"] == 1)).mean() > 0.98
    odd = toxicity.score_toxicity(odd_docs.withColumn("toxicity", F.lit("clash")), model)
    assert odd.count() == odd_docs.count() and odd.schema["toxicity"].dataType.simpleString() == "double"
    got = {r["doc_id"]: r["toxicity"] for r in odd.collect()}
    assert got[900] == got[901] == got[902] and all(0 <= v <= 1 for v in got.values())
    assert toxicity.score_toxicity(no_docs, model).count() == 0


def test_toxicity_without_labels(spark, documents):
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(documents, none)
    assert toxicity.score_toxicity(documents, model).agg(F.countDistinct("toxicity")).first()[0] == 1


def test_language_of_held_out_documents(documents):
    model = langid.train_language_model(documents, where=F.col("doc_id") % 3 != 1)
    found = langid.predict_language(documents.where("doc_id % 3 = 1"), model).toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() > 0.95


def test_language_of_odd_rows(documents, odd_docs, no_docs):
    model = langid.train_language_model(documents)
    odd = langid.predict_language(odd_docs.withColumn("LANG_pred", F.lit(1)), model).collect()
    got = {r["doc_id"]: r for r in odd}
    for i in (900, 901, 902, 903):
        assert (got[i]["lang_pred"], got[i]["lang_score"], got[i]["lang_accepted"]) == ("und", 0.0, False)
    assert got[904]["lang_pred"] in model.labels and got[907]["lang_pred"] in model.labels
    assert len(odd) == odd_docs.count() and langid.predict_language(no_docs, model).count() == 0
    assert langid.train_language_model(no_docs) is None
    assert {r["lang_pred"] for r in langid.predict_language(odd_docs, None).collect()} == {"und"}


def test_language_scores_do_not_depend_on_neighbours_or_pieces():
    model = langid.fit(["the cat and the dog " * 9, "le chat et le chien " * 9] * 30, ["en", "fr"] * 30)
    texts = ["the dog", "le chien noir", "a" * 50, "the cat " * 4000]
    alone = np.concatenate([langid.scores([t], model) for t in texts])
    assert np.allclose(langid.scores(texts, model), alone, atol=1e-6)
    raw = [langid.folded(t) for t in texts]
    whole = langid.sums(raw, model.logits, 16)
    cut = langid.sums(raw, model.logits, 16, most=64)
    assert np.allclose(whole[0], cut[0], rtol=1e-3) and (whole[1] == cut[1]).all()


def test_co_training_helps_the_view_with_many_words():
    """The content view meets most words in no labelled row; the page view tells the pool's rows apart for it."""
    rng = np.random.default_rng(5)

    def row(good: bool):
        return ((np.array([10 + int(rng.integers(200)) + (500 if good else 0)]), np.ones(1)), (np.array([2000 + int(good)]), np.ones(1)))

    y = np.arange(40) % 2 == 0
    rows, pool, test = [row(g) for g in y], [row(g) for g in rng.random(4000) < 0.5], rng.random(2000) < 0.5
    views = [[r[v] for r in map(row, test)] for v in (0, 1)]
    right = {}
    for rounds in (0, 1, 3):
        model = quality.fit([[r[v] for r in rows] for v in (0, 1)], y, [[r[v] for r in pool] for v in (0, 1)], rounds=rounds, sure=0.8)
        p = quality.probabilities(model, views)
        assert p.shape == (2000, 3) and ((p >= 0) & (p <= 1)).all()
        z = quality.raw(model.weights[0], views[0])
        right[rounds] = ((z > np.median(z)) == test).mean()
    assert right[1] > right[0] + 0.1 and right[3] > right[1] + 0.02, right


def test_few_labels_give_no_calibration():
    one = lambda at: (np.array([at]), np.ones(1))
    y = np.array([1, 0, 1, 0])
    model = quality.fit([[one(5 + g) for g in y], [one(9 + g) for g in y]], y, [[], []])
    assert not model.calibrated and model.scales == [(1.0, 0.0)] * 2
    assert langid.fit(["the cat", "le chat"], ["en", "fr"]).calibrated is False


def test_symbol_runs_count_whole():
    assert quality.word_values("!!!!") != quality.word_values("!!!") and quality.word_values("a" + "-" * 9) != quality.word_values("a" + "-" * 8)


def test_quality_where_labels_repeat(documents, labels):
    """Of an id's labels the lowest counts, however often it is there."""
    few = documents.where("doc_id < 120")
    model = quality.train_quality(few, labels)
    again = quality.train_quality(few, labels.unionByName(labels).unionByName(labels.where("quality = 0").withColumn("quality", F.lit(1))))
    assert all((a == b).all() for a, b in zip(model.weights, again.weights, strict=True)) and model.scales == again.scales


def test_every_round_of_co_training_adds_pseudo_labels(monkeypatch):
    rng = np.random.default_rng(5)
    one = lambda at: (np.array([at]), np.ones(1))
    row = lambda good: (one(10 + int(rng.integers(5)) + 50 * int(good)), one(200 + int(good)))
    y = np.arange(200) % 2 == 0
    rows, pool = [row(g) for g in y], [row(g) for g in rng.random(600) < 0.5]
    trained, plain = [], quality.logistic
    monkeypatch.setattr(quality, "logistic", lambda r, labels, **k: trained.append(len(r)) or plain(r, labels, **k))
    quality.fit([[r[v] for r in rows] for v in (0, 1)], y, [[r[v] for r in pool] for v in (0, 1)])
    for v in (0, 1):  # a tenth of the pool in each of three rounds, by view
        assert (np.diff(trained[v::2]) >= 58).all() and len(trained[v::2]) == 4


def test_quality_finds_junk(spark, documents, labels):
    model = quality.train_quality(documents, labels)
    found = quality.score_quality(documents, model).join(labels, "doc_id").toPandas()
    assert (found["quality_kept"] == (found["quality"] == 1)).mean() > 0.9


def test_quality_of_odd_rows(spark, documents, labels, odd_docs, no_docs):
    model = quality.train_quality(documents, labels)
    assert quality.score_quality(odd_docs.withColumn("quality_score", F.lit("x")), model).count() == odd_docs.count()
    assert quality.score_quality(no_docs, model).count() == 0
    one_kind = labels.withColumn("quality", F.lit(1))
    assert quality.train_quality(documents, one_kind) is None
    assert {r["quality_kept"] for r in quality.score_quality(odd_docs, None).collect()} == {True}


def test_platt_and_ranking():
    rng = np.random.default_rng(2)
    z = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * z - 1)))).astype(float)
    a, b = quality.platt(z, y)
    assert a == pytest.approx(2, abs=0.25) and b == pytest.approx(-1, abs=0.2)
    assert quality.ranking(np.array([1.0, 2, 3, 4]), np.array([0, 0, 1, 1])) == 1
    assert quality.ranking(np.array([1.0, 1]), np.array([0, 1])) == 0.5


def test_a_fit_hands_its_memory_back():
    """What a fit returned or raised passes through, and what it held is gone afterwards."""
    import re

    from tessera.llm.common import hands_memory_back

    def held() -> int:
        return int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) // 1024

    @hands_memory_back
    def fit(n, *, fails=False):
        rows = [bytes(200) + str(k).encode() for k in range(n)]
        if fails:
            raise ValueError("no model")
        return len(rows)

    before = held()
    assert fit(400_000) == 400_000 and held() - before < 40
    with pytest.raises(ValueError, match="no model"):
        fit(10, fails=True)


@pytest.fixture(scope="module")
def hot(spark):
    """30,000 different rows of one labelled id, and as many copies of one row of another."""
    docs = spark.range(60_000).select(F.when(F.col("id") < 30_000, 1).otherwise(2).cast("long").alias("doc_id"), F.when(F.col("id") < 30_000, F.concat(F.lit("der hund "), F.col("id").cast("string"), F.lit(" x"))).otherwise("the cat").alias("text"), F.lit("de").alias("lang"), F.lit("a").alias("source"))
    return docs, spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("most", [{"most_rows": 10}, {"most_rows": 50_000, "most_bytes": 900}])
def test_samples_of_a_hot_id_are_bounded(hot, monkeypatch, most):
    docs, labels = hot
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda features, y, **_: seen.append((len(features), sum(f.nbytes for f in features))))
    toxicity.train_toxicity(docs, labels, **most)
    monkeypatch.setattr(quality, "fit", lambda views, y, pool, **_: seen.append((len(y), 0)) or seen.append((len(pool[0]), 0)))
    quality.train_quality(docs, labels, most_pool=10, **most)
    assert all(n <= most["most_rows"] and size <= most.get("most_bytes", size) for n, size in seen) and len(seen) == 3
    if "most_bytes" in most:
        assert all(n < 100 for n, _ in seen)


def test_language_sample_of_a_hot_id_is_bounded(hot, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "fit", lambda texts, langs, **_: seen.append((len(texts), sum(map(len, texts)))))
    langid.train_language_model(hot[0], per_language=20)
    langid.train_language_model(hot[0], per_language=50_000, most_bytes=1000)
    langid.train_language_model(hot[0].withColumn("lang", F.concat(F.lit("l"), F.col("doc_id").cast("string"))), most_languages=1, per_language=10)
    assert 0 < seen[0][0] <= 20 and 0 < seen[1][1] <= 1000 and 0 < seen[2][0] <= 10
