"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, langid, media, merkle, mixing, neardup, pii, quality, resample, token_store, toxicity
from .common import fresh, id_crc, materialize, table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file: the folder in TOKENIZERS_DIR, or that of the installed package."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.pmod(id_crc("doc_id"), F.lit(4)) == 2, F.lit(False))
    model = toxicity.train_toxicity(docs, labels, where=~held)
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model, threshold=0.3)
    return scored.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), F.col("is_toxic").alias("predicted"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_digests(token_store.write_tokens(table(spark, sf_dir, "documents"), vocabulary(), end_id=1))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.store_media(table(spark, sf_dir, "documents")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs.select("doc_id", "text", "lang", "source"), model).select("doc_id", "quality_score", "content_score", "page_score", F.col("quality_kept").alias("kept"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), query=F.col("vec_id") % 20 == 0, k=20)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary())


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mix.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(more)
    return chat.conversation_digests(materialize(chat.format_conversations(rows), "chat"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(id_crc("doc_id"), F.lit(3)) == 1, F.lit(False))
    model = langid.train_language_model(docs, where=~held)
    found = langid.predict_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: s["base"])
    counts = [pii.count_of(base, k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed_spans(base), 256).alias("base_sha256"), pii.listed_spans(F.col("pii_spans")).alias("spans"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.when(F.pmod(id_crc("doc_id"), F.lit(3)) == 0, merkle.leaf(text=merkle.lowered("text")))
    made = merkle.manifest(table(spark, sf_dir, "documents"), carry={"doc_id": F.col("doc_id"), "again": lowered})
    folded = merkle.folded(F.coalesce("again", "hash"))
    rows = made.proofs().select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", merkle.proof().alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


# --- stages of the pipeline: documents in, documents out -----------------------------------------


def _filtered(docs: DataFrame, written: set[str], judged: Callable[[DataFrame], DataFrame], flag: str) -> DataFrame:
    """Rows of ``docs`` for which the operator sets the flag; own columns of the names it writes step aside meanwhile."""
    own = {c: f"{c}__own" for c in docs.columns if c.lower() in written}
    kept = judged(docs.withColumnsRenamed(own)).where(flag)
    return kept.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is accepted. Null texts and those without letters go; repeated rows go or stay alike, very long
    texts are judged whole; without a row to learn from none is accepted; an empty table stays empty."""
    model = langid.train_language_model(docs)
    return _filtered(docs, {"lang_pred", "lang_score", "lang_accepted"}, lambda d: langid.predict_language(d, model), "lang_accepted")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier keeps. A null text is judged as empty, repeated rows alike, very long texts whole; without labels
    of both kinds all rows stay; an empty table stays empty."""
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return _filtered(docs, {"quality_score", "content_score", "page_score", "quality_kept"}, lambda d: quality.score_quality(d, model), "quality_kept")


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each component stays, once; a row without an id only where no other has one.

    Rows are judged one by one, by a number written with them: ids may be null or stand for several texts. Texts
    without words are linked with nothing; of those, rows equal in id and text stay once, rows without an id all.
    """
    row, own_id, same, by = fresh(docs, "_row", "_id", "_same", "_by")
    plain = [c for c, kind in docs.dtypes if "map<" not in kind]  # maps have no hash
    docs_ = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "stage-rows")
    found = neardup.near_duplicates(docs_.select(row, "text"), id_column=row)
    # One narrow row each; of equal ids the smallest hash of the whole row stays, so runs agree.
    narrow = docs_.select(row, F.col("doc_id").alias(own_id), F.xxhash64("text").alias(same), F.xxhash64(*plain).alias(by))
    alone = (F.col("n_shingles") == 0) & F.col(own_id).isNotNull()
    group = [F.when(~alone, F.col("component_id")).alias("a"), F.when(alone, F.col(own_id)).alias("b"), F.when(alone, F.col(same)).alias("c")]
    first = F.min(F.struct(F.col(own_id).isNull().alias("x"), own_id, by, row))
    kept = found.join(narrow, row).groupBy(*group).agg(first.alias("first")).select(F.col(f"first.{row}").alias(row))
    return docs_.join(kept, row, "left_semi").select(*docs.columns)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them. Null and empty texts have no words to mix and count as documents of size 0; ties of ids
    are told apart by their text; an empty table stays empty."""
    return mixing.mixed_rows(docs)


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token ids: doc_id, n_tokens, token_ids, their digest, that of the decoded text, and
    restores, whether the ids spell the text's normalised words again."""
    return bpe.round_trip_digests(docs, vocabulary(), keep_ids=True)


STAGES = [
    ("language ID", stage_language),
    ("quality classifier", stage_quality),
    ("MinHash near-dedup", stage_near_duplicates),
    ("mixing sources to target weights", stage_mixing),
    ("BPE encoding and decoding", stage_bpe),
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_token_output, op3_media_columns, op4_quality, op5_nearest_neighbours, op6_bpe, op7_near_duplicates, op8_mixing, op9_chat, op10_language, op11_pii, op12_resampling, op13_merkle)}


#: Targets by the level that fills all sources, thresholds by sorting: the same rows by another way.
MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT * 16384 + ('0x' || substr(md5(coalesce(text, '')), 1, 4))::BIGINT // 4 AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT source, n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, sum(n) OVER () AS total FROM s),
o AS (SELECT *, 3.0::DOUBLE * n / weight AS level, coalesce(sum(3 * n) OVER k, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER k, 0) AS open FROM w WINDOW k AS (ORDER BY 3.0::DOUBLE * n / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT (total - capped)::DOUBLE / open AS fill FROM o WHERE (total - capped)::DOUBLE / open <= level ORDER BY level LIMIT 1),
t AS (SELECT source, n, CASE WHEN weight * fill > 3 * n THEN (3 * n)::DOUBLE ELSE weight * fill END AS target FROM w LEFT JOIN f ON TRUE),
p AS (SELECT *, CASE WHEN n > 0 THEN least(floor(target / n), 3)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
b AS (SELECT source, h, words, coalesce(sum(words) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
c AS (SELECT b.source, h, whole + (before + words <= target - whole * n OR (before <= target - whole * n AND words - (target - whole * n - before) < target - whole * n - before))::BIGINT AS copies FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id, d.size, p.n AS source_size, p.target, (d.size * least(c.copies, 3))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""

#: Turns and losses straight from the table; the formatted form is spelled out turn by turn.
CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n, length('<|' || replace(replace(replace(role, '\', '\\'), '<', '\<'), '|', '\|') || '|>' || replace(replace(text, '\', '\\'), '<', '\<') || '<|end|>') AS chars FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
e AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
(sum(upto) FILTER (role = 'assistant' OR k = n))::BIGINT AS formatted_chars FROM e GROUP BY conv_id
"""

#: crc32 by a table of bytes, once for each distinct feature; no postings, documents and gains are joined by bucket.
RESAMPLING_SQL = r"""
WITH
crcs AS (SELECT list(list_reduce([n, -1, -1, -1, -1, -1, -1, -1, -1], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY n) AS t FROM range(256) r(n)),
texts AS (SELECT TRUE AS own, row_number() OVER () AS k, doc_id, text FROM documents UNION ALL SELECT FALSE, row_number() OVER (), NULL, text FROM benchmark),
words AS (SELECT own, k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT own, k, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM words),
counts AS (SELECT own, k, f, count(*) AS n FROM runs GROUP BY own, k, f),
hashed AS (SELECT f, xor(list_reduce([4294967295::BIGINT] || list_transform(range(strlen(f)), lambda i: ('0x' || substr(hex(f), 2 * i::INT + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT f FROM counts), crcs),
lists AS (SELECT own, k, bucket, sum(n)::BIGINT AS n FROM counts JOIN hashed USING (f) GROUP BY own, k, bucket),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0)::BIGINT AS s, coalesce(sum(n) FILTER (NOT own), 0)::BIGINT AS t FROM lists GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM sums),
weights AS (SELECT k, sum(n * gain)::BIGINT AS weight FROM lists JOIN gains USING (bucket) WHERE own GROUP BY k),
scored AS (SELECT doc_id, len(w) AS n, len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM words LEFT JOIN weights USING (k) WHERE own),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) FILTER (n >= 20) OVER () AS known FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n >= 20 AND place <= 5 * known // 100 THEN place END AS rank FROM ranked
"""

#: Trees by recursion over groups of eight, proofs by walking up with the runs of each level.
MERKLE_SQL = r"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS k, *, list_reduce([4294967295::BIGINT] || flatten(list_transform(range(length(doc_id::VARCHAR)), lambda i: [ord(substr(doc_id::VARCHAR, i::INT + 1, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END) AS crc FROM documents),
f AS (SELECT k, lang, doc_id, crc, concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head, text FROM d),
h AS (SELECT k, lang, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN doc_id IS NOT NULL AND xor(crc, 4294967295) % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS again FROM f),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM h),
node(lang, level, i, n, h) AS (SELECT lang, 0, i, n, leaf FROM leaves UNION ALL SELECT lang, any_value(level) + 1, i // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY lang, i // 8),
tops AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1),
peak(level, i, n, h) AS (SELECT 0, i, n, h FROM tops UNION ALL SELECT any_value(level) + 1, i // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY i)) FROM peak WHERE n > 1 GROUP BY i // 8),
runs AS (SELECT lang, level, i // 8 AS up, list(h ORDER BY i) AS own FROM node WHERE n > 1 GROUP BY lang, level, i // 8),
over AS (SELECT level, i // 8 AS up, list(h ORDER BY i) AS own FROM peak WHERE n > 1 GROUP BY level, i // 8),
walk(k, lang, level, i, h, sides) AS (
  SELECT k, lang, 0, i, coalesce(again, leaf), '' FROM leaves
  UNION ALL
  SELECT w.k, w.lang, w.level + 1, w.i // 8, sha256(array_to_string(own[1:w.i % 8], '') || w.h || array_to_string(own[w.i % 8 + 2:], '')), w.sides || array_to_string(own[1:w.i % 8], '') || array_to_string(own[w.i % 8 + 2:], '')
  FROM walk w JOIN runs r ON w.lang IS NOT DISTINCT FROM r.lang AND w.level = r.level AND w.i // 8 = r.up),
at_top AS (SELECT k, w.h, sides, t.i, t.h AS subroot FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY k ORDER BY level DESC) = 1) w JOIN tops t ON w.lang IS NOT DISTINCT FROM t.lang),
climb(k, level, i, h, sides) AS (
  SELECT k, 0, i, h, sides FROM at_top
  UNION ALL
  SELECT c.k, c.level + 1, c.i // 8, sha256(array_to_string(own[1:c.i % 8], '') || c.h || array_to_string(own[c.i % 8 + 2:], '')), c.sides || array_to_string(own[1:c.i % 8], '') || array_to_string(own[c.i % 8 + 2:], '')
  FROM climb c JOIN over o ON c.level = o.level AND c.i // 8 = o.up),
done AS (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY k ORDER BY level DESC) = 1)
SELECT l.doc_id, l.leaf, a.subroot, r.h AS root, sha256(e.sides) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM leaves l JOIN at_top a USING (k) JOIN done e USING (k), (SELECT h FROM peak WHERE n = 1) r
"""


def oracle_sql() -> dict[str, str]:
    """Models, codes, images, search and merges are beyond SQL and are tested by brute force."""
    return {"op8_mixing": MIXING_SQL, "op9_chat": CHAT_SQL, "op12_resampling": RESAMPLING_SQL, "op13_merkle": MERKLE_SQL}
