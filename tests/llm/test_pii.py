"""Personal data: base spans against plain Python, trees against planted rules, redaction."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import pii, queries

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def sums_to_ten(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    found = []
    for kind, pattern in zip(pii.KINDS, PATTERNS, strict=True):
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))) or (kind == "card" and 16 <= len(digits) <= 19 and sums_to_ten(digits)) or (kind == "phone" and 8 <= len(digits) <= 15):
                found.append((kind, m.start(), m.end()))
    return found


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def checked(rows: list, texts: dict) -> None:
    for r in rows:
        want = base_spans(texts[r["doc_id"]])
        n = Counter(k for k, _, _ in want)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [n[k] for k in pii.KINDS] and r["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest(), (texts[r["doc_id"]], r)
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]
        assert set(want) <= set(spans) and spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def got(spark, df, tmp_path) -> list:
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return queries.op11_pii(spark, str(tmp_path)).collect()


def test_documents(spark, sf_dir, documents):
    rows = queries.op11_pii(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert len(rows) == len(texts)
    checked(rows, texts)


def test_random_texts(spark, tmp_path):
    """Runs of the characters that matter, so that matches touch, nest, fail and follow each other."""
    rng = random.Random(11)
    parts = ["1", "12", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "+1 (826) 555-4081", "+49", "a", "x_y", "@", "b.c", ".", "..", " ", "-", "(", ")", "%", "é", "256", "1.2.3.4", "0010.0.0.255", "300.1.1.1", "\n", "😀", "me@h.org", "a (at) b (dot) c"]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for i in range(3000)}
    checked(got(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), tmp_path), texts)


def test_odd_rows(spark, odd_docs, tmp_path):
    """Null, empty and long texts, repeated rows, clashing names; long unbroken runs take linear time."""
    runs = ["x", "1", "1.", "+1" + " 2" * 999 + "(", "a@", "a@b" + ".c" * 999, "- ", "12 "]
    texts = {2000 + i: (t * (2000 // len(t) + 1)) for i, t in enumerate(runs)}
    more = odd_docs.unionByName(spark.createDataFrame([(i, t, None, None, 1) for i, t in texts.items()], odd_docs.schema)).withColumns({c: F.lit(1) for c in ("row", "g", "kind", "start", "end", "score", "_text", "spans")})
    rows = got(spark, more, tmp_path)
    assert len(rows) == more.count()
    checked([r for r in rows if r["doc_id"] is not None], {r["doc_id"]: r["text"] for r in more.collect()})
    # A hundred times as long, plain Python would look at them for hours
    long = spark.createDataFrame([(i, t * 100) for i, t in texts.items()], "doc_id long, text string")
    assert pii.pii_spans(long).count() == len(texts)


def test_no_rows(spark, no_docs, tmp_path):
    assert got(spark, no_docs, tmp_path) == []


def planted() -> list[str]:
    """Texts with one base span each, half of which fail their check; the last one holds what the rules drop."""
    rng = random.Random(3)

    def card() -> str:
        body = "4" + "".join(str(rng.randint(0, 9)) for _ in range(14))
        return next(body + c for c in "0123456789" if sums_to_ten(body + c))

    rows = []
    for _ in range(300):
        rows += [f"Des +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} or", f"du {card()} x", f"at {rng.randint(0, 255)}.{rng.randint(0, 255)}.1.2, on", f"no {rng.randint(10**15, 10**16 - 1)} so", f"v {rng.randint(256, 999)}.1.2.3 x", f"+{rng.randint(1, 9)}-{rng.randint(10, 99)} x"]
    return [*rows, f"Des +1 (826) 555-4081 190.137.223.204 du {card()} {card()} x"]


def test_spans_that_the_rules_drop_are_added(spark):
    """A phone number that runs into an address, cards next to each other; numbers that only look alike stay."""
    rows = planted()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r["doc_id"]: r["pii_spans"] for r in pii.pii_spans(df).collect()}
    text, added = rows[-1], [s for s in found[len(rows) - 1] if not s["base"]]
    cards = re.findall("[0-9]{16}", text)
    assert {text[s["start"] : s["end"]] for s in added} == {"+1 (826) 555-4081", *cards} and all(0.5 <= s["score"] <= 1 for s in added)
    wrong = [rows[i] for i in found if i < len(rows) - 1 and any(not s["base"] for s in found[i])]
    assert len(wrong) <= 3, wrong


def test_trees_learn_a_pair_of_features():
    """Accepted exactly where two features agree; the calibrated share is right in each cell."""
    rng = np.random.default_rng(2)
    x = np.stack(np.meshgrid(*([np.arange(2)] * 5), indexing="ij"), axis=-1).reshape(-1, 5)
    x = np.pad(x, ((0, 0), (0, len(pii.FEATURES) - 5)))
    x[:, [0, -1]] = x[:, [-1, 0]]  # kind is constant
    x = np.concatenate([x, x])
    held, n = np.arange(len(x)) % 2 == 0, rng.integers(50, 100, len(x))
    good = np.where(x[:, 1] == x[:, 2], np.round(0.98 * n), np.round(0.02 * n)).astype(int)
    model = pii.fit(x, good, n, held)
    a, b = model.scale
    p = 1 / (1 + np.exp(-(a * pii.raw(model, x) + b)))
    assert np.abs(p - good / n).max() < 0.03 and 0.5 <= model.thresholds[0] <= 0.99 and model.thresholds[1:] == [2.0] * 3
    assert pii.fit(x, n, n, held) is None


def test_column_of_trees_is_the_model(spark):
    rows = pii.candidates(spark.createDataFrame([(t,) for t in planted()], "text string"), text="text", keep=[]).where("g is not null")
    model = pii.train_spans(rows)
    both = rows.select(*pii.FEATURES, pii.probability(model).alias("p")).collect()
    a, b = model.scale
    want = 1 / (1 + np.exp(-(a * pii.raw(model, np.array([[r[f] for f in pii.FEATURES] for r in both])) + b)))
    assert [r["p"] for r in both] == pytest.approx(want)


def test_redaction(spark):
    texts = ["mail é😀 me@h.org or +1 (826) 555-4081.", None, "", "1.2.3.4", "no", "a+1 22 333 4444@h.org x", "1.2.3.4 9.9.9.9"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("redacted", F.lit(0))
    rows = {r["doc_id"]: r["redacted"] for r in pii.redact(df).collect()}
    assert [rows[i] for i in range(7)] == ["mail é😀 [EMAIL] or [PHONE].", None, "", "[IP]", "no", rows[5], "[IP] [IP]"]
    assert "h.org" not in rows[5] and rows[5].endswith(" x")


def test_native(documents):
    plan = pii.pii_spans(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|InPandas", plan)
