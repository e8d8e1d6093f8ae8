"""Mixing sources to target weights, with DataFrame functions only.

Sizes are word counts. A source's target is its weight's share of all words, but at most ``most_repeats``
times its own size; what is cut off is dealt again by weight until no source is above. A target of r
times a source's size takes every document floor(r) times, and once more those whose hash is under the
source's threshold. Thresholds come from hash histograms: words are summed by source and the highest
bits of the hash, the bucket in which the running sum passes the budget is split by the next bits, and
so on; only boundary buckets are ever split. Budgets are nested: a larger budget keeps what a smaller
one took. Nothing is sorted but histogram rows and sources, and nothing comes to the driver: targets and
thresholds are tables with one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, without

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Hash bits of each histogram: 48 from the MD5 of the id as text, then 14 from that of the text, which
#: tell rows of one id apart. Other engines have MD5 too.
LEVELS = (12, 12, 12, 12, 14)


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))


def hash62(id_column: str, text: str) -> Column:
    """48 bits of the id's MD5, then 14 of the text's; nulls hash as the empty text."""
    bits = lambda column, digits: F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), 1, digits), 16, 10).cast("long")
    return F.shiftleft(bits(id_column, 12), 14) + F.shiftright(bits(text, 4), 2)


def water_filled(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_repeats: int = 3) -> DataFrame:
    """source, n, target. sizes: source, n (its words); sources take the weights in turn by code point, null last.

    A source is full at the level most_repeats * n / weight. In order of these levels, the words left over and the
    weights still open give the level that all others are filled to, at the first source whose own level is not below it.
    """
    # One row a source: these windows sort names and sums, never documents.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "n", turn.alias("weight")).withColumn("full", most_repeats * F.col("n") / F.col("weight"))
    before = Window.orderBy("full", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = rows.withColumn("left", F.sum("n").over(every) - F.coalesce(F.sum(most_repeats * F.col("n")).over(before), F.lit(0)))
    rows = rows.withColumn("fill", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("fill") <= F.col("full"), F.struct("full", "fill"))).over(every)["fill"]
    return rows.select("source", "n", F.least(F.col("weight") * level, (most_repeats * F.col("n")).cast("double")).alias("target"))


def _histogram(rows: DataFrame, bits_after: int) -> DataFrame:
    """Words by source and bucket, with the running sum before each bucket. rows: src, size, hash, budget."""
    sums = rows.groupBy("src", "budget", F.shiftright("hash", bits_after).alias("bucket")).agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0).cast("long")))


def mix(df: DataFrame, *, text: str = "text", id_column: str = "doc_id", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most_repeats: int = 3) -> DataFrame:
    """Every row of ``df`` with mix_size, mix_source_size, mix_target, mix_copies (0 to ``most_repeats``).

    A row's words are taken mix_copies times. The last bucket's documents are taken where that brings
    the source nearer to its target, so a source misses it by half of its last boundary bucket's words at
    most. Where ids are unique that is half of one document; rows of one id, or without an id, are told
    apart by 14 bits of their text's hash, so of them a 16,384th part, or those equal in text too, share
    their fate. Null texts have size 0; null sources are a source of their own. A very long text
    is one document of its size, counted in its row's task. An empty table stays empty.
    Columns of these four names are replaced.
    """
    df = without(df, "mix_size", "mix_source_size", "mix_target", "mix_copies")
    src, hash_, size = fresh(df, "_src", "_hash", "_size")
    # Null sources get a key that no text can have: a text's key starts with "=".
    key = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))
    keyed = df.select("*", key.alias(src), hash62(id_column, text).alias(hash_), word_count(text).alias(size))
    rows = materialize(keyed.groupBy(F.col(src).alias("src"), F.col(hash_).alias("hash")).agg(F.sum(size).alias("size")), "mix-sizes")
    sums = rows.groupBy("src").agg(F.sum("size").alias("n")).select(F.when(F.col("src") != "null", F.substr("src", F.lit(2))).alias("source"), "n")
    targets = water_filled(sums, weights, most_repeats).withColumn("whole", F.when(F.col("n") > 0, F.least(F.floor(F.col("target") / F.col("n")), F.lit(most_repeats))).otherwise(0).cast("int"))
    plan = materialize(targets.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("src"), "n", "target", "whole"), "mix-plan")
    # Sources with words still to take, the prefix of their boundary bucket, and its budget; those that are settled have a threshold.
    going = plan.select("src", F.lit(0).cast("long").alias("prefix"), (F.col("target") - F.col("whole") * F.col("n")).alias("budget")).where("budget > 0")
    settled, at, total = None, 0, sum(LEVELS)
    for bits in LEVELS:
        at += bits
        inside = rows.join(going, "src").where(F.shiftright("hash", total - at + bits) == F.col("prefix"))
        crossed = _histogram(inside, total - at).where((F.col("before") <= F.col("budget")) & (F.col("before") + F.col("words") > F.col("budget")))
        found = going.join(crossed.select("src", "bucket", "before", "words"), "src", "left")
        # No bucket passes the budget: all that is left here is taken.
        left = F.col("budget") - F.col("before")
        last = F.shiftleft(F.col("bucket") + F.when(F.col("words") - left < left, 1).otherwise(0), total - at)
        ended = F.when(F.col("bucket").isNull(), F.shiftleft(F.col("prefix") + 1, total - at + bits)).when(F.lit(at == total), last)
        found = materialize(found.select("src", F.col("bucket").alias("prefix"), left.alias("budget"), ended.alias("under")), "mix-level")
        done = found.where("under is not null").select("src", "under")
        settled, going = done if settled is None else settled.unionByName(done), found.where("under is null").select("src", "prefix", "budget")
    whole, under = fresh(df, "_whole", "_under")
    chosen = plan.join(settled, "src", "left").select(F.col("src").alias(src), F.col("n").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("whole").alias(whole), F.coalesce("under", F.lit(0).cast("long")).alias(under))
    chosen = materialize(chosen, "mix-chosen")  # a table whose size Spark sees: with few sources no document is shuffled
    copies = F.least(F.col(whole) + (F.col(hash_) < F.col(under)).cast("int"), F.lit(most_repeats))
    return keyed.join(chosen, src).select(*df.columns, F.col(size).alias("mix_size"), "mix_source_size", "mix_target", copies.alias("mix_copies"))


def mixed_rows(df: DataFrame, **settings) -> DataFrame:
    """The mix itself: rows of ``df`` as often as they are taken, with the columns of ``df``."""
    own = {c: f"{c}__own" for c in df.columns if c.lower().startswith("mix_")}  # columns that the mix would replace
    taken = mix(df.withColumnsRenamed(own), **settings).where("mix_copies > 0")
    (copy,) = fresh(taken, "_copy")
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*(F.col(own.get(c, c)).alias(c) for c in df.columns))
