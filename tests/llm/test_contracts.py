"""Every registered query: columns, types, one row for each row, and its rows by plain Python where that can make them."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tessera.llm import langid, queries, quality, toxicity
from tessera.llm.common import Cache
from tokenizers import Tokenizer

CONTRACTS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_token_output": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op3_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op4_quality": "doc_id bigint, quality_score double, content_score double, page_score double, kept boolean",
    "op5_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op6_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7_near_duplicates": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op8_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op9_chat": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op10_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op11_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op12_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint",
    "op13_merkle": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
}
LIBRARY = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    made = {}

    def get(name):
        if name not in made:
            df = queries.queries()[name](spark, sf_dir)
            made[name] = dict(df.dtypes), df.toPandas()
        return made[name]

    return get


@pytest.fixture(scope="module")
def docs(documents):
    return documents.toPandas().set_index("doc_id", drop=False)


def crc(i: int) -> int:
    return zlib.crc32(str(i).encode())


@pytest.mark.parametrize("name", CONTRACTS)
def test_columns_and_rows(results, docs, name):
    kinds, rows = results(name)
    for column in CONTRACTS[name].split(", "):
        named, kind = column.split()
        assert kinds[named] == kind, named
    if "doc_id" in rows:
        assert sorted(rows["doc_id"]) == sorted(docs["doc_id"])
    assert not rows[[c.split()[0] for c in CONTRACTS[name].split(", ")]].isna().any().any()


def test_op12_ranks(results):
    kinds, rows = results("op12_resampling")
    ranks = sorted(rows["rank"].dropna())
    assert kinds["rank"] == "bigint" and ranks == list(range(1, len(ranks) + 1))


def test_op1(spark, results, docs, labels, documents):
    _, rows = results("op1_toxicity")
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.itertuples())
    known = labels.toPandas().set_index("doc_id")["toxic"]
    terms = lambda t: toxicity.distinct_terms(t, Cache(toxicity.word_terms, 10**6))
    learned = sorted(i for i in docs["doc_id"] if i in known.index and crc(i) % 4 != 2)
    model = toxicity.fit([terms(docs["text"][i]) for i in learned], known[learned].to_numpy() > 0)
    place = {int(t): k for k, t in enumerate(model.terms)}
    for r in rows.itertuples():  # the sum over all pairs, text by text
        own = [place[int(t)] for t in terms(docs["text"][r.doc_id]) if int(t) in place]
        z = model.w0 + sum(model.w[i] for i in own) + sum(model.v[i] @ model.v[j] for a, i in enumerate(own) for j in own[a + 1 :])
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_op1_learns_nothing_from_held_out_rows(spark, results, sf_dir, tmp_path, labels):
    """Labels of held-out rows turned around: the same scores."""
    import os

    for name in os.listdir(sf_dir):
        if not name.startswith("labels"):
            os.symlink(f"{sf_dir}/{name}", tmp_path / name)
    turned = labels.toPandas()
    turned["toxic"] = [1 - t if crc(i) % 4 == 2 else t for i, t in zip(turned["doc_id"], turned["toxic"], strict=True)]
    turned.to_parquet(tmp_path / "labels.parquet")
    again = queries.op1_toxicity(spark, str(tmp_path)).toPandas()
    assert again.sort_values("doc_id")["score"].tolist() == results("op1_toxicity")[1].sort_values("doc_id")["score"].tolist()


def test_op2_and_op6(results, docs):
    by = results("op6_bpe")[1].set_index("doc_id")
    at = 0
    for r in results("op2_token_output")[1].sort_values("doc_id").itertuples():
        text = docs["text"][r.doc_id] or ""
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        packed = np.array([*ids, 1], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) + 1, zlib.crc32(packed))
        assert by["n_tokens"][r.doc_id] == len(ids) and by["ids_sha256"][r.doc_id] == hashlib.sha256(packed[:-4]).hexdigest()
        assert by["decoded_sha256"][r.doc_id] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        at += r.n_tokens


def test_op3(results, docs):
    seen = {}
    for r in results("op3_media_columns")[1].itertuples():
        data = (docs["text"][r.doc_id] or "").encode()
        full = data + b" " * (-len(data) % 192 if data else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert seen.setdefault(data, (r.media_sha256, r.media_bytes, r.feature)) == (r.media_sha256, r.media_bytes, r.feature)


def test_op4(results, docs, documents, labels):
    model = quality.train_quality(documents, labels)
    for r in results("op4_quality")[1].itertuples():
        d = docs.loc[r.doc_id]
        z = []
        for w, (a, b), (ids, x) in zip(model.weights, model.scales, (quality.content_view(d["text"], Cache(quality.word_values, 10**6)), quality.page_view(d["text"], d["lang"], d["source"])), strict=True):
            z.append(a * (w[-1] + sum(w[i] * v for i, v in zip(ids, x, strict=True))) + b)
        want = [1 / (1 + np.exp(-v)) for v in (np.dot(model.shares, z), *z)]
        assert (r.quality_score, r.content_score, r.page_score) == pytest.approx(want, abs=1e-6) and r.kept == (r.quality_score >= model.threshold)


def test_op5(spark, results, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    found = results("op5_nearest_neighbours")[1]
    hit = 0
    for q in (asked := [i for i in ids if i % 20 == 0]):
        s = (x * x[ids == q][0]).sum(axis=1)
        s[ids == q] = -np.inf
        own = found[found["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and own["score"].tolist() == [s[ids == i][0] for i in own["vec_id"]]
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(own["vec_id"]))
    assert hit >= 0.9 * 20 * len(asked)


def test_op7(results, docs):
    from test_corpus import brute_components, shingles

    want = brute_components(dict(zip(docs["doc_id"], docs["text"], strict=True)), 3, 85)
    for r in results("op7_near_duplicates")[1].itertuples():
        assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(shingles(docs["text"][r.doc_id], 3)), r.doc_id == want[r.doc_id])


def test_op10(results, docs):
    _, rows = results("op10_language")
    langs = {docs["lang"][i] for i in docs["doc_id"] if crc(i) % 3 != 1 and docs["lang"][i]}
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 for r in rows.itertuples())
    for r in rows.itertuples():
        has = any(c.isalpha() for c in docs["text"][r.doc_id] or "")
        assert (r.lang_pred in langs) if has else (r.lang_pred == "und" and r.score == 0)
    held = rows[rows["held_out"]]
    known = held[[docs["lang"][i] is not None for i in held["doc_id"]]]
    assert np.mean([docs["lang"][i] == p for i, p in zip(known["doc_id"], known["lang_pred"], strict=True)]) > 0.95


def test_language_scores_by_plain_sums(documents):
    """A text's score from its grams one by one."""
    model = langid.train_language_model(documents)
    for text in ("Der Hund und die Katze.", "le chat", "a", "ß9!"):
        data, z = langid.folded(text), []
        padded = data + langid.GAP
        for i in range(len(data)):
            g = [int.from_bytes(padded[i : i + n], "little") for n in (3, 4)]
            z += [model.logits[(g[0] * 2654435761 % 2**32) >> 16], model.logits[((g[1] * 2246822519 + 374761393) % 2**32) >> 16]]
        z = (np.sum(z, axis=0, dtype=float) / len(z) + model.bias) / model.temperature
        p = np.exp(z - z.max())
        assert langid.scores([text], model)[0] == pytest.approx(p / p.sum(), abs=1e-5)
