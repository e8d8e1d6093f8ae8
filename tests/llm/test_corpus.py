"""Near duplicates, mixing, chat, neighbours and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import ann, chat, common, langid, mixing, neardup, quality, queries

import corpus_pipeline


def shingles(text: str | None, n: int) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < n else (tuple(w[k : k + n]) for k in range(len(w) - n + 1)))


def brute_components(docs: dict, n: int, percent: int) -> dict:
    sets = {i: shingles(t, n) for i, t in docs.items()}
    root = {i: i for i in docs}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def copies(seed: int, n: int, words: int = 80) -> list[str]:
    """A text and drifting copies of it: some near the threshold, some linked only through others."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = [base]
    for _ in range(n - 1):
        t = list(rng.choice(out[-6:] if rng.random() < 0.5 else [base]))
        for _ in range(rng.randrange(5)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        out.append(t)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_like_brute_force(spark, words, percent):
    texts = [t for s in range(3) for t in copies(s, 60)] + copies(9, 12) * 3 + ["a b", "a b", "A  b", "", None, "one"]
    rows = [(i * 7 % 1009, t, "x") for i, t in enumerate(texts)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, signature string"), words=words, percent=percent).collect()
    docs = {i: t for i, t, _ in rows}
    want = brute_components(docs, words, percent)
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) and r["n_shingles"] == len(shingles(docs[r["doc_id"]], words)) for r in found)


def test_near_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    found = neardup.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"]} == {900: 900, 901: 901, 902: 902, 903: 903, 904: 904, 905: 904, 906: 906, 907: 907}
    assert [tuple(r)[2:] for r in found if r["doc_id"] is None] == [(None, True)]
    assert neardup.near_duplicates(no_docs).count() == 0


def test_bayesian_bounds():
    least = neardup.least_matches(0.85, 1e-4)
    assert all(0 < m <= (k + 1) * neardup.BATCH for k, m in enumerate(least)) and list(least) == sorted(least)
    rng = np.random.default_rng(0)
    own = rng.integers(0, 1000, neardup.MINIMA)
    others = np.where(rng.random((2000, neardup.MINIMA)) < 0.87, own, -1)
    assert len(neardup.survivors(own, others, least)) >= 1990
    far = np.where(rng.random((2000, neardup.MINIMA)) < 0.6, own, -1)
    assert len(neardup.survivors(own, far, least)) < 20
    for t in (0.8, 0.85, 0.95):
        rows, bands = neardup.band_shape(t, 1e-4)
        assert rows * bands <= neardup.MINIMA and (1 - t**rows) ** bands <= 1e-4


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1000)], "a long, b long")
    found = {r["id"]: r["component"] for r in neardup.components(links).collect()}
    assert found == {i: 0 for i in range(1, 301)} | {1001: 1000}


def filled_by_rounds(sizes: list, weights=(5, 2, 1), most: int = 3) -> dict:
    """Targets by dealing again and again what is cut off."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight, size = {s: weights[i % 3] for i, (s, _) in enumerate(order)}, dict(order)
    target, open_, left = dict.fromkeys(size, 0.0), set(size), float(sum(size.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * left / total > most * size[s]}
        for s in above or open_:
            target[s] = float(most * size[s]) if above else weight[s] * left / total
        left -= sum(target[s] for s in above)
        open_ = open_ - above if above else set()
    return target


def test_water_filling(spark):
    rng = random.Random(8)
    many = [[(f"s{k}" if k else None, rng.choice([0, 1, 10, 500, 10_000])) for k in range(rng.randrange(1, 12))] for _ in range(6)]
    for sizes in ([("a", 10), ("b", 1000), ("c", 5)], [(None, 7), ("z", 0), ("y", 100)], [("a", 0)], [], [("a", 100), ("b", 100), ("c", 100)], *many):
        rows = mixing.water_filled(spark.createDataFrame(sizes, "source string, n long")).collect()
        want = filled_by_rounds(sizes)
        assert {r["source"]: r["target"] for r in rows} == pytest.approx(want) and len(rows) == len(sizes)
        assert sum(want.values()) == pytest.approx(sum(n for _, n in sizes))


def test_mixing_against_sorting(spark, documents):
    rows = mixing.mix(documents.select("doc_id", "text", "source")).toPandas()
    for _, own in rows.groupby("source"):
        n, target = own["mix_size"].sum(), own["mix_target"].iloc[0]
        assert n == own["mix_source_size"].iloc[0]
        taken = (own["mix_size"] * own["mix_copies"]).sum()
        assert abs(taken - target) <= own["mix_size"].max() / 2 + 1
        assert own["mix_copies"].max() - own["mix_copies"].min() <= 1 and own["mix_copies"].max() <= 3


def test_mixing_of_odd_rows(odd_docs, no_docs):
    rows = mixing.mix(odd_docs.withColumn("mix_size", F.lit("x"))).collect()
    assert len(rows) == odd_docs.count() and {r["mix_size"] for r in rows if r["doc_id"] in (900, 901, 902)} == {0}
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd_docs.repartition(3)).collect()))  # whatever the partitions
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_rows(no_docs).count() == 0
    copies_ = Counter(r["doc_id"] for r in mixing.mixed_rows(odd_docs).collect())
    want = Counter()
    for r in rows:
        want[r["doc_id"]] += r["mix_copies"]
    assert copies_ == +want


@pytest.mark.parametrize("ids", ["one", "null"])
def test_mixing_of_a_hot_id(spark, ids):
    """A third of a source's rows share an id, or have none; its target is met all the same."""
    rng = random.Random(2)
    rows = [((7 if ids == "one" else None) if k % 3 == 0 else k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60))), "ab"[k % 2]) for k in range(1800)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, own in found.groupby("source"):
        assert abs((own["mix_size"] * own["mix_copies"]).sum() - own["mix_target"].iloc[0]) <= 30


def test_mixing_sql_where_ids_repeat(spark, odd_docs, tmp_path):
    import duckdb
    from oracle import difference

    rng = random.Random(4)
    more = [(rng.choice([None, 3, k]), " ".join(["word"] * rng.randrange(9) + [f"w{rng.randrange(50)}"]), "en", rng.choice(["a", "b", None]), 1) for k in range(400)]
    odd_docs.unionByName(spark.createDataFrame(more, odd_docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert difference(queries.op8_mixing(spark, str(tmp_path)).toPandas(), con.execute(queries.MIXING_SQL).df()) == ""


def test_mixing_is_native(documents):
    """Neither Python workers nor rows from the driver in the plan."""
    df = mixing.mix(documents.select("doc_id", "text", "source"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan and "LocalTableScan" not in plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # texts stay where they are


TURNS = [
    (1, 0, "system", "be \\ <|end|> kind"), (1, 1, "user", "hi <|assistant|>"), (1, 2, "assistant", "a\\<b"), (1, 3, "user", None), (1, 4, "assistant", "zwei\n<|"), (1, 5, "user", "bye"),
    (2, 0, "assistant", "only"), (3, 1, "user", "no reply"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (4, 0, None, "r"), (4, 0, "a|b\\", "é😀"), (4, 1, "assistant", ""), (4, 1, "assistant", ""),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    examples = chat.format_conversations(df).collect()
    by = defaultdict(list)
    for r in examples:
        by[r["conv_id"]].append(r)
    want = defaultdict(list)
    for c, t, r, x in sorted(TURNS, key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2] is not None, v[2] or "", v[3] or "")):
        want[c].append((r, x or ""))
    for c, turns in want.items():
        own = sorted(by[c], key=lambda r: r["example"])
        assert chat.parsed(own[-1]["formatted"]) == turns and own[-1]["last"]
        replies = [r for r in own if r["loss_end"] > r["loss_start"] or turns[r["example"] - 1][0] == "assistant"]
        assert [chat.unescaped(r["formatted"][r["loss_start"] : r["loss_end"]]) for r in replies] == [x for ro, x in turns if ro == "assistant"]
        for r in own:
            assert chat.parsed(r["formatted"]) == turns[: r["example"]]
    digests = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_conversations(df)).collect()}
    assert digests[1]["n_turns"] == 6 and digests[1]["loss_chars"] == len("a\\<b" + "zwei\n<|") and digests[3]["loss_chars"] == 0
    assert chat.format_conversations(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        chat.parsed("<|user|>open")


def test_chat_of_long_texts_and_clashing_columns(spark):
    long = "wort <| \\ " * 30_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    df = df.withColumn("formatted", F.lit("own")).withColumn("example", F.lit(9)).withColumn("_conv", F.lit(8)).withColumn("LAST", F.lit(True))
    examples = chat.format_conversations(df)
    assert examples.columns == ["conv_id", "example", "last", "formatted", "loss_start", "loss_end"]
    got = {r["conv_id"]: r for r in chat.conversation_digests(examples).collect()}
    assert got[1]["loss_chars"] == len(long) and got[1]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest() and got[1]["n_turns"] == 2
    assert got[1]["turns_sha256"] == hashlib.sha256(f"user\n{long}\nassistant\n{long}\n".encode()).hexdigest()


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(1200, 16)).astype(np.float32)
    v[100:160] = v[100]  # very many equal vectors
    rows = [(i, [float(x) for x in v[i]], "x") for i in range(1200)] + [(5000, None, "n"), (5001, [0.0] * 16, "z"), (5002, [float("nan")] * 16, "f"), (5003, [1.0], "d"), (None, [1.0] * 16, "i"), (5005, [None] * 16, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    found = ann.nearest_neighbours(df, query=F.col("vec_id") % 20 == 0, k=10).toPandas()
    hit = 0
    x = v.astype(float)
    for q in range(0, 1200, 20):
        own = found[found["query_id"] == q].sort_values("rank")
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        true = np.lexsort((np.arange(1200), -s))[:10]
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own["score"], s[own["vec_id"]], rtol=0, atol=1e-12)
        assert own[["score", "vec_id"]].apply(lambda r: (-r["score"], r["vec_id"]), axis=1).is_monotonic_increasing
        hit += len(set(true) & set(own["vec_id"]))
    assert hit / 600 >= 0.9
    few = ann.nearest_neighbours(df.where("vec_id < 6"), k=20).toPandas()
    assert len(few) == 30 and set(few["rank"]) == set(range(1, 6))
    assert ann.nearest_neighbours(df.where("false")).count() == 0 and ann.nearest_neighbours(df.where("vec_id >= 5000")).count() == 0


@pytest.mark.parametrize("kind", ["hot id", "hot row", "doubled"])
def test_neighbours_of_repeated_rows(spark, kind):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16)) * 3
    v = (centres[np.arange(900) // 3 % 30] + rng.normal(size=(900, 16)) * 0.1).astype(np.float32)
    ids = np.arange(900)
    if kind == "hot id":  # one id on a third of the rows, with many vectors
        ids[::3] = 0
    elif kind == "hot row":
        ids, v = np.append(ids, np.zeros(450, int)), np.concatenate([v, np.repeat(v[:1], 450, axis=0)])
    else:
        ids, v = np.tile(ids, 2), np.tile(v, (2, 1))
    df = spark.createDataFrame([(int(i), [float(c) for c in x]) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<float>")
    found = ann.nearest_neighbours(df, query=F.col("vec_id") % 90 < 3, k=20).toPandas()
    x, hit, asked = v.astype(float), 0, [i for i in np.unique(ids) if i % 90 < 3]
    for q in asked:
        s = {}
        for row in x[ids == q]:
            for i, p in zip(ids, (x * row).sum(axis=1), strict=True):
                if i != q:
                    s[i] = max(p, s.get(i, -np.inf))
        true = sorted(s, key=lambda i: (-s[i], i))[:20]
        own = found[found["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and own["vec_id"].is_unique
        assert np.all(own["score"] <= [s[i] + 1e-12 for i in own["vec_id"]])
        hit += len(set(true) & set(own["vec_id"]))
    assert hit / (20 * len(asked)) >= 0.9


def test_rows_a_query_looks_at_grow_slower_than_the_table():
    """Clustered vectors, leaves of fixed size: what 95 % of the true neighbours cost."""
    rng = np.random.default_rng(7)
    looked = {}
    for n in (2000, 16_000):
        centres = rng.normal(size=(n // 40, 32)) * 4
        x = centres[np.arange(n) % len(centres)] + rng.normal(size=(n, 32)) * 0.3
        forest = ann.grow(x, trees=3, leaf_points=64)
        at, sizes = ann.leaves_of(forest, x), np.zeros(forest.leaves)
        for t in range(3):
            np.add.at(sizes, at[:, t], 1)
        ranks, costs = [], []
        for q in range(0, n, n // 60):
            s = x @ x[q]
            s[q] = -np.inf
            order = ann.visit_order(forest, x[q] @ forest.normals.T - forest.cuts, forest.leaves)
            rank = {leaf: r for r, leaf in enumerate(order)}
            ranks += [min(rank[leaf] for leaf in at[i]) for i in np.argsort(-s)[:20]]
            costs.append(np.cumsum(sizes[order]))
        budget = sorted(ranks)[int(0.95 * len(ranks))]
        looked[n] = float(np.mean([c[budget] for c in costs]))
    assert looked[16_000] < 3 * looked[2000] and looked[16_000] < 0.25 * 16_000, looked


def test_vectors_of_doubles_keep_their_digits(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8)) * np.array([1e60] + [1.0] * 7)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.nearest_neighbours(df, k=3).toPandas()
    assert len(found) == 180 and all(r.score == (x[r.query_id] * x[r.vec_id]).sum() for r in found.itertuples())


def test_a_walk_works_out_only_the_nodes_it_meets():
    """A few leaves of many take a few paths, however many nodes there are; lazily or all at once, the order is one."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 8))
    forest = ann.grow(x, trees=2, leaf_points=4)

    class Counted(ann.Margins):
        met = 0

        def __getitem__(self, at):
            self.met += 1
            return super().__getitem__(at)

    for q in x[:5]:
        lazily = Counted(forest, q)
        assert ann.visit_order(forest, lazily, 6) == ann.visit_order(forest, forest.normals @ q - forest.cuts, 6)
        assert lazily.met <= 8 * 20 < len(forest.normals) / 10


def test_queue_visits_all_leaves_best_first():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8))
    f = ann.grow(x, trees=3, leaf_points=20)
    m = x[:1] @ f.normals.T - f.cuts
    order = ann.visit_order(f, m[0], f.leaves)
    assert sorted(order) == list(range(f.leaves)) and set(order[:3]) == set(ann.leaves_of(f, x[:1])[0])


def test_pipeline_stages(spark, sf_dir, documents):
    docs, names = documents, documents.columns
    for name, stage in queries.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == names, name
        assert out.join(docs, "doc_id", "left_anti").count() == 0, name
        docs = out
    last = corpus_pipeline.run(spark, sf_dir)
    assert last.count() == docs.count() and last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids", "restores"]


def test_near_duplicate_stage_judges_rows(spark, sf_dir):
    """Colliding and null ids: brute force over the rows, each with its own number."""
    texts = [copies(s, 12) for s in range(4)]
    rows = [(7, t) for t in (texts[0][0], texts[1][0], texts[2][0])]  # one id, three texts
    rows += [(9, texts[3][0]), (3, texts[3][0]), (9, "another text of nine that nothing else is near to")]
    rows += [(None, texts[1][1]), (None, texts[1][0])] + [(None, "copies without an id " * 5)] * 3
    rows += [(5, texts[0][0])] * 2 + [(11, ""), (11, ""), (11, " "), (None, ""), (None, None)]
    numbered = dict(enumerate(t for _, t in rows))
    groups = defaultdict(list)
    for n, c in brute_components(numbered, 5, 80).items():
        i, t = rows[n]
        groups[c if (t or "").split() or i is None else (i, t)].append(n)
    want = Counter()
    for own in groups.values():
        ids = [rows[n][0] for n in own if rows[n][0] is not None]
        n = next(n for n in own if rows[n][0] == (min(ids) if ids else None))
        want[(rows[n][0], len(shingles(rows[n][1], 5)))] += 1
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 7):
        out = queries.stage_near_duplicates(spark, df.repartition(parts), sf_dir)
        got = Counter((r["doc_id"], len(shingles(r["text"], 5))) for r in out.collect())
        assert out.columns == df.columns and got == want


def test_pipeline_against_plain_python(spark, sf_dir, documents, labels):
    """The two classifiers' decisions row by row; then components, the mix, and ids by brute force."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = documents.toPandas()
    language = langid.train_language_model(documents)
    docs = docs[[bool(langid.has_letter(t)) and langid.scores([t], language).max() >= language.threshold for t in docs["text"]]]
    model = quality.train_quality(spark.createDataFrame(docs, documents.schema), labels)
    views = [[quality.content_view(t, common.Cache(quality.word_values, 10**6)) for t in docs["text"]], [quality.page_view(t, a, b) for t, a, b in zip(docs["text"], docs["lang"], docs["source"], strict=True)]]
    docs = docs[quality.probabilities(model, views)[:, 0] >= model.threshold]
    component = brute_components(dict(zip(docs["doc_id"], docs["text"], strict=True)), 5, 80)
    docs = docs[[component[i] == i for i in docs["doc_id"]]]
    size = {r.doc_id: len(re.findall(rb"[^\x20\x09-\x0D]+", r.text.encode())) for r in docs.itertuples()}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    times = Counter(r["doc_id"] for r in rows)
    assert set(times) <= set(docs["doc_id"]) and all(r["restores"] for r in rows)
    words = docs.groupby("source", dropna=False)["doc_id"].apply(lambda ids: sum(size[i] for i in ids)).to_dict()
    target = filled_by_rounds([(None if s != s else s, n) for s, n in words.items()])
    for s, own in docs.groupby("source", dropna=False):
        assert abs(sum(size[i] * times[i] for i in own["doc_id"]) - target[None if s != s else s]) <= max(size[i] for i in own["doc_id"]) / 2 + 1
    library, texts = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))), dict(zip(docs["doc_id"], docs["text"], strict=True))
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)


def test_pipeline_takes_odd_and_no_documents(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        for _, stage in queries.STAGES:
            stage(spark, docs, sf_dir).count()


def test_stages_keep_columns_of_any_name(spark, sf_dir, documents):
    names = ["quality_kept", "LANG_pred", "mix_size", "_src", "_copy", "_hash", "signature"]
    docs = documents
    for n in names:
        docs = docs.withColumn(n, F.lit(f"own {n}"))
    for name, stage in queries.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.select(*names).distinct().collect() == [tuple(f"own {n}" for n in names)], name


def test_queries_against_their_sql(spark, sf_dir):
    from oracle import connection, difference

    con = connection(sf_dir)
    for name, sql in queries.oracle_sql().items():
        assert difference(queries.queries()[name](spark, sf_dir).toPandas(), con.execute(sql).df()) == "", name
