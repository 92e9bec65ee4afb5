"""A Merkle manifest of a dataset: digests per row, per group and of the whole.

Rows are numbered inside their group, and one level of the tree after the
other is made by a slot pivot: conditional aggregates spread the children of a
parent into one column per slot. The columns joined together give the parent's
digest; without the own slot they are the siblings of a child. Going back from
the root, every level hands its children the siblings on their way up.

Digests are stored as 32 bytes and hashed as hex text. A level has an eighth
of the rows of the one below, a parent has at most eight children, and groups
of any size spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentdup.llm.ordering import number_within
from contentdup.operators.settle import settle

FANOUT = 8
_SLOTS = [f"slot{i}" for i in range(FANOUT)]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left: binary, right: binary>>"


def hex_text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return digest(F.concat(*map(field_text, fields)))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _joined(columns: list[Column]) -> Column:
    """The digests that are there, one after the other."""
    return F.concat(*(F.coalesce(c, F.lit(b"")) for c in columns))


@dataclass
class Tree:
    """``levels``: per level one row per parent with its children in slots, and
    ``is_top`` for a lone node without a parent. ``tops``: ``key, digest``."""

    levels: list[DataFrame]
    tops: DataFrame


def build_tree(nodes: DataFrame, label: str) -> Tree:
    """Trees over ``key, place, digest``, one per ``key``, with places from 0."""
    levels = []
    while True:
        slot = F.col("place").bitwiseAND(F.lit(FANOUT - 1))
        spread = (F.max(F.when(slot == i, F.col("digest"))).alias(name) for i, name in enumerate(_SLOTS))
        pivoted = nodes.groupBy("key", F.shiftright("place", 3).alias("place")).agg(*spread)
        # Only a node without any other at its level is alone in the first parent.
        wide = settle(pivoted.withColumn("is_top", (F.col("place") == 0) & F.col("slot1").isNull()), label).df
        levels.append(wide)
        nodes = wide.where("NOT is_top").select("key", "place", digest(hex_text(_joined([F.col(c) for c in _SLOTS]))).alias("digest"))
        if nodes.isEmpty():
            break
    tops = [level.where("is_top").select("key", F.col("slot0").alias("digest")) for level in levels]
    return Tree(levels, reduce(DataFrame.unionByName, tops))


def _siblings(place: Column, slots: list[Column]) -> Column:
    """Left and right siblings of the child at ``place``, from the slots of its
    parent without the own one."""
    slot = place.bitwiseAND(F.lit(FANOUT - 1))
    left = _joined([F.when(slot > i, c) for i, c in enumerate(slots)])
    right = _joined([F.when(slot < i, c) for i, c in enumerate(slots)])
    return F.struct(left.alias("left"), right.alias("right"))


def paths_to_children(tree: Tree, above: DataFrame, carried: list[str]) -> Callable[[DataFrame], DataFrame]:
    """How to add ``path`` (siblings level by level, then the path in ``above``)
    and ``carried`` to the lowest nodes of the trees.

    ``above``: one row per key with ``path`` and ``carried``. It meets the lone
    top of its tree and goes down from there, so no group is joined by its key.
    """
    above = above.select(F.col("key").alias("top_key"), "path", *carried)

    def with_tops(level: DataFrame) -> DataFrame:
        tops = level.where("is_top").join(above, F.col("key") == F.col("top_key"))
        return tops.select("key", "place", "is_top", *_SLOTS, "path", *carried)

    def step(children: DataFrame, parents: DataFrame) -> DataFrame:
        """Children with their own siblings before the path of their parent."""
        up = parents.select(
            *(F.col(c).alias(f"up_{c}") for c in ("key", "place", "is_top", "path", *_SLOTS)), *carried
        )
        met = children.join(up, (F.col("key") == F.col("up_key")) & (F.shiftright("place", 3) == F.col("up_place")))
        own = F.array(_siblings(F.col("place"), [F.col(f"up_{c}") for c in _SLOTS]))
        # A lone top has no parent; its row stands for itself.
        path = F.when(F.col("up_is_top"), F.col("up_path")).otherwise(F.concat(own, F.col("up_path")))
        return met.select(*children.columns, path.alias("path"), *carried)

    placed = with_tops(tree.levels[-1])
    for level in reversed(tree.levels[:-1]):
        placed = step(level.where("NOT is_top"), placed).unionByName(with_tops(level))
    return lambda nodes: step(nodes, placed)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    up = lambda node, level: digest(F.concat(hex_text(level["left"]), hex_text(node), hex_text(level["right"])))
    return F.aggregate(path, leaf, up)


def merkle_manifest(docs: DataFrame, tampered: Column, group: str = "lang", order: str = "doc_id") -> DataFrame:
    """Leaf, group root, root and proof of every row of ``docs``, and whether
    each row still leads to the root after ``tampered`` rows had their text
    changed (A-Z in lower case).

    Nulls are part of the digest as ``-``; rows without a group form the first
    group. Rows with one ``doc_id`` are ordered by their leaf, so equal rows are
    leaves of their own; rows without ``doc_id`` come first. Texts of any
    length are digested whole in the JVM. Further columns are ignored; an
    empty table gives no rows.
    """
    columns = [F.col(name) for name in FIELDS]
    changed = [lower_ascii(c) if name == "text" else c for name, c in zip(FIELDS, columns)]
    leaf = leaf_digest(columns)
    leaves = docs.select(
        # Nulls first, then by bytes.
        F.coalesce(F.concat(F.lit("+"), F.col(group)), F.lit("")).alias("key"),
        F.col(order).alias("doc_id"),
        leaf.alias("digest"),
        # Null: the row was left alone.
        F.when(tampered, leaf_digest(changed)).alias("altered"),
    )
    # Written first: dealing out by ranges reads its input twice.
    leaves = settle(leaves, "merkle-digests").df
    numbered = number_within(leaves, "key", ["doc_id", "digest"], "merkle-leaves")
    nodes = settle(numbered.select("key", (F.col("pos") - 1).alias("place"), "doc_id", "digest", "altered"), "merkle-nodes").df

    groups = build_tree(nodes.select("key", "place", "digest"), "merkle-level")
    tops = number_within(groups.tops.withColumnRenamed("key", "group_key").withColumn("key", F.lit("")), "key", ["group_key"], "merkle-tops")
    tops = settle(tops.select("key", (F.col("pos") - 1).alias("place"), "group_key", "digest"), "merkle-groups").df
    whole = build_tree(tops.select("key", "place", "digest"), "merkle-top-level")

    root = whole.tops.select("key", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    over_groups = paths_to_children(whole, root, ["root"])(tops.select("key", "place", "group_key", "digest"))
    above = over_groups.select(F.col("group_key").alias("key"), "path", F.col("digest").alias("subroot"), "root")
    above = settle(above, "merkle-above").df
    proven = paths_to_children(groups, above, ["subroot", "root"])(nodes)

    siblings = F.aggregate("path", F.lit("").cast("binary"), lambda acc, level: F.concat(acc, level["left"], level["right"]))
    folded = fold(F.coalesce("altered", "digest"), F.col("path"))
    return proven.select(
        "doc_id", "digest", "subroot", "root", siblings.alias("siblings"), folded.alias("folded"), (F.size("path")).alias("n_levels")
    ).select(
        "doc_id",
        hex_text(F.col("digest")).alias("leaf"),
        hex_text(F.col("subroot")).alias("subroot"),
        hex_text(F.col("root")).alias("root"),
        F.sha2(hex_text(F.col("siblings")).cast("binary"), 256).alias("proof_sha256"),
        hex_text(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
        "siblings",
        "n_levels",
    )
