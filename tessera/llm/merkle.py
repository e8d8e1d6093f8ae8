"""Merkle manifest of a dataset: one hash tree for each group of rows, and one over the groups' roots.

A row's leaf is the SHA-256 of its fields, each as ``-`` if null, else its UTF-8 byte count, ``:`` and its value.
Leaves of a group stand in the order of an id; every ``FAN`` consecutive nodes (the last ones: fewer) become the
SHA-256 of their hexadecimal digests, level by level, until one node is left, the group's subroot. The subroots in
the order of their groups give the root in the same way.

Places come from a range shuffle and the counts of its pieces, so that no group is sorted in one task. A level is
one window partitioned by group and parent: its ordered full-frame ``collect_list`` is the preimage of the parent
and, without the row's own node, its siblings. Each parent is taken once, from its first child. Proofs come down
again by joins of children with their parents: groups of ``FAN`` rows at most, however large a group is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered, release

FAN = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: tuple[str, ...] = FIELDS, **instead: Column) -> Column:
    """The leaf of a row; ``instead`` has other values for some of its fields."""
    return digest(*(field(instead.get(c, F.col(c))) for c in fields))


def _hex(packed: Column) -> Column:
    return F.lower(F.hex(packed))


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Tables from the leaves up: the columns of ``nodes`` (group, place, n, hash, ...), parent, above, left and right.

    left and right: the digests of the siblings before and after, packed; null where the node is alone in its
    group, which then stands for itself on the next level. most: nodes of the largest group.
    """
    made, own = [], list(nodes.columns)
    run = Window.partitionBy("group", "parent").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    while most > 1:
        at = F.pmod("place", F.lit(FAN)).cast("int")
        level = nodes.withColumn("parent", F.floor(F.col("place") / FAN)).withColumn("run", F.collect_list("hash").over(run))
        side = lambda first, size: F.when(F.col("n") > 1, F.unhex(F.array_join(F.slice("run", first, size), "")))
        above = F.when(F.col("n") > 1, F.sha2(F.array_join("run", ""), 256)).otherwise(F.col("hash"))
        level = materialize(level.select(*own, "parent", above.alias("above"), side(F.lit(1), at).alias("left"), side(at + 2, F.lit(FAN)).alias("right")), "merkle-level")
        made.append(level)
        first = level.where(F.pmod("place", F.lit(FAN)) == 0)
        nodes = first.select("group", F.col("parent").alias("place"), F.ceil(F.col("n") / FAN).alias("n"), F.col("above").alias("hash"))
        own, most = nodes.columns, -(-most // FAN)
    return [*made, materialize(nodes, "merkle-top")]


def _most(nodes: DataFrame) -> int:
    return nodes.agg(F.max("n")).first()[0] or 0


def _down(levels: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Paths of the lowest level's nodes. paths: group, place, path and what else each node inherits, for the top level."""
    inherited = [c for c in paths.columns if c not in ("group", "place", "path")]
    for level in reversed(levels[:-1]):
        above = paths.select(F.col("group").alias("_group"), F.col("place").alias("_place"), F.col("path").alias("_path"), *inherited)
        step = F.when(F.col("left").isNull(), F.col("_path")).otherwise(F.concat(F.array(F.struct("left", "right")), "_path"))
        joined = level.join(above, (F.col("group") == F.col("_group")) & (F.col("parent") == F.col("_place")))
        paths = joined.select(*(c for c in level.columns if c not in ("parent", "above", "left", "right")), step.alias("path"), *inherited)
    return paths


NO_PATH = "cast(array() as array<struct<left: binary, right: binary>>)"


@dataclass
class Manifest:
    """Tables of the trees, all in the shared folder."""

    leaves: list[DataFrame]  # levels of the groups' trees, the lowest with the carried columns
    subroots: list[DataFrame]  # levels of the tree over the groups, the lowest with the group's value

    def proofs(self) -> DataFrame:
        """A row for each leaf: the carried columns, hash (the leaf), subroot, root, and path, its siblings up to the root."""
        top = self.subroots[-1].select("group", "place", F.expr(NO_PATH).alias("path"), F.col("hash").alias("root"))
        groups = _down(self.subroots, top)
        if len(self.subroots) > 1:
            groups = groups.select(F.col("of").alias("group"), F.lit(0).cast("long").alias("place"), "path", F.col("hash").alias("subroot"), "root")
        else:  # one group: its subroot is the root
            only = self.subroots[0].select(F.col("of").alias("group"), F.lit(0).cast("long").alias("place"), F.expr(NO_PATH).alias("path"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
            groups = only
        if len(self.leaves) == 1:  # every group is a lone leaf
            here = self.leaves[0]
            return here.join(groups.drop("place"), "group").drop("group", "place", "n")
        return _down(self.leaves, groups).drop("group", "place", "n")

    def release(self) -> None:
        release(*self.leaves, *self.subroots)


def manifest(df: DataFrame, *, id_column: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None) -> Manifest:
    """Trees over every row of ``df``: a leaf of its ``fields``, groups by ``group``, leaves by ``id_column``.

    carry: columns to keep with each leaf. Null groups are a group of their own, before all others; null ids
    come first. Rows of one id stand in the order of their leaves, so equal rows have equal leaves at
    neighbouring places. A very long text is hashed whole, in its row's task. An empty table has no root and
    no proofs. Further columns of ``df`` are not read; they may have any names.
    """
    carry = carry or {}
    # A key that is never null, in the groups' order: null's is shorter than any other.
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = materialize(df.select(key.alias("group"), F.col(id_column).alias("_id"), leaf(fields).alias("hash"), *(c.alias(name) for name, c in carry.items())), "merkle-leaves")
    placed = numbered(rows, "group", [F.col("_id").asc_nulls_first(), F.col("hash")], place="place", count="n").drop("_id")
    placed = placed.select("group", "place", "n", "hash", *carry)
    leaves = _levels(placed, _most(placed))
    tops = leaves[-1].select(F.lit("").alias("group"), F.col("group").alias("of"), "hash")
    subroots = numbered(tops, "group", [F.col("of")], place="place", count="n").select("group", "place", "n", "hash", "of")
    release(rows)
    return Manifest(leaves, _levels(subroots, _most(subroots)))


def proof(path: str = "path") -> Column:
    """SHA-256 of all siblings on the way up, from left to right on each level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: _hex(F.concat(s["left"], s["right"]))), ""), 256)


def folded(start: Column, path: str = "path") -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, start, lambda at, s: digest(_hex(s["left"]), at, _hex(s["right"])))


def lowered(text: str) -> Column:
    """The text with A to Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)
