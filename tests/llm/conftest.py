from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    (None, "no id at all", "en", "a", 12),
    (900, None, None, None, None),
    (901, "", "en", "a", 0),
    (902, " \n\t ", "en", None, 4),
    (903, "$$$ 123 !!!", "en", "a", 11),
    (904, "tie tie tie", "en", "a", 11),
    (905, "tie tie tie", "en", "a", 11),
    (905, "tie tie tie", "en", "a", 11),
    (906, "naïve Σας 你好 <|endoftext|> \x00 x", "fr", "ü", 30),
]


def long_text(n: int = 60_000) -> str:
    return " ".join(f"w{i % 997}" for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame([*ODD, (907, long_text(), "en", "a", 1)], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
