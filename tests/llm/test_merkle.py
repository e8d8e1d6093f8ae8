"""Merkle manifests against plain Python."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from tessera.llm import merkle, queries
from tessera.llm.common import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: dict) -> str:
    return sha(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def lowered(text: str | None) -> str | None:
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(nodes: list[str]) -> tuple[str, list[list]]:
    """The root, and the siblings before and after on each level of each node's way up."""
    paths: list[list] = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            run = nodes[i - i % 8 : i - i % 8 + 8]
            path.append((run[: i % 8], run[i % 8 + 1 :]))
        nodes = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], paths


def expected(rows: list[dict]) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    made = []
    for lang in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        own = sorted(groups[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        made.append((own, *tree([leaf(r) for r in own])))
    root, over = tree([subroot for _, subroot, _ in made])
    out = []
    for (own, subroot, paths), up in zip(made, over, strict=True):
        for r, path in zip(own, paths, strict=True):
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            at = leaf(r | {"text": lowered(r["text"])} if changed else r)
            for before, after in path + up:
                at = sha(*before, at, *after)
            siblings = [s for before, after in path + up for s in (*before, *after)]
            out.append((r["doc_id"], leaf(r), subroot, root, sha(*siblings), at, at == root))
    return out


def placed_at(df, tmp_path) -> str:
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def got(spark, sf_dir: str) -> list[tuple]:
    return sorted(map(tuple, queries.op13_merkle(spark, sf_dir).collect()), key=str)


def test_documents(spark, sf_dir, documents):
    rows = got(spark, sf_dir)
    assert rows == sorted(expected([r.asDict() for r in documents.collect()]), key=str)
    assert {r[-1] for r in rows} == {True, False}


def test_odd_rows(spark, odd_docs, tmp_path):
    """Null ids and languages, empty and long texts, ties, repeated rows, further columns of clashing names."""
    more = odd_docs.withColumns({c: F.lit(1) for c in ("group", "place", "n", "hash", "path", "again", "of")})
    assert got(spark, placed_at(more, tmp_path)) == sorted(expected([r.asDict() for r in odd_docs.collect()]), key=str)


@pytest.mark.parametrize("sizes", [[], [1], [8], [9], [1, 1], [65, 1, 1], [1] * 70, [70] * 9])
def test_shapes(spark, no_docs, tmp_path, sizes):
    """Lone leaves, one group, full and broken runs, more groups than one run holds."""
    rows = [(1000 * g + i, f"Text {i}", f"l{g:02}", None, i) for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, no_docs.schema)
    assert got(spark, placed_at(docs, tmp_path)) == sorted(expected([r.asDict() for r in docs.collect()]), key=str) if rows else got(spark, placed_at(docs, tmp_path)) == []


def test_hot_group_is_numbered_in_pieces(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("group"), (F.col("id") * 7919 % 5000).alias("by"))
    rows = numbered(df.repartition(8), "group", [F.col("by")], place="at", count="n").collect()
    for group in "ab":
        own = sorted((r for r in rows if r["group"] == group), key=lambda r: r["by"])
        assert [r["at"] for r in own] == list(range(len(own))) and {r["n"] for r in own} == {len(own)}


def test_a_changed_leaf_does_not_verify(spark, documents):
    made = merkle.manifest(documents, carry={"doc_id": F.col("doc_id"), "again": merkle.leaf(text=F.concat("text", F.lit(" ")))})
    rows = made.proofs().select((merkle.folded(F.col("hash")) == F.col("root")).alias("own"), (merkle.folded(F.col("again")) == F.col("root")).alias("changed")).collect()
    assert len(rows) == 200 and all(r["own"] and not r["changed"] for r in rows)
    made.release()
