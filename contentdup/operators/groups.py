"""Grouping items that share a key, flat and whatever the size of a group.

The flat form (one row per member) is the working form. A group may hold a
large part of all rows, so groups are only ever counted with map-side
combining, and joined back in a way that keeps any one key from filling a
task: keys above ``hot_limit`` rows are few by construction and go by
broadcast, the others by a shuffle in which every key stays below the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentdup.operators.settle import Settled

KEYS = ["size_bytes", "digest"]

# At most this many keys can lie above the limit, so their table is small.
HOT_KEYS = 10_000
# Below this many rows a key is never worth separate treatment.
HOT_FLOOR = 200_000


def hot_limit(n_rows: int, floor: int | None = None) -> int:
    floor = HOT_FLOOR if floor is None else floor
    return max(floor, -(-n_rows // HOT_KEYS))


def count_groups(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Keys held by two or more rows, with ``n_files``."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files")).where("n_files > 1")


def join_groups(
    rows: DataFrame, groups: DataFrame, n_rows: int, keys: list[str] = KEYS, floor: int | None = None
) -> DataFrame:
    """Inner join of rows with one row per key that carries ``n_files``.

    ``n_rows`` is the number of rows; no key can exceed it, so small inputs
    need no hot branch at all.
    """
    limit = hot_limit(n_rows, floor)
    if n_rows <= limit:
        return rows.join(groups, keys)
    hot = groups.where(F.col("n_files") > limit)
    cold = groups.where(F.col("n_files") <= limit)
    in_hot = rows.join(F.broadcast(hot), keys)
    in_cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return in_hot.unionByName(in_cold)


def rows_and_bytes() -> dict[str, Column]:
    """Figures of a table of items, for :func:`contentdup.operators.settle.settle`."""
    return {"n_rows": F.count(F.lit(1)), "n_bytes": F.sum("size_bytes")}


def shared_rows(rows: Settled, keys: list[str] = KEYS, floor: int | None = None) -> DataFrame:
    """Rows whose key occurs more than once, with ``n_files``."""
    return join_groups(rows.df, count_groups(rows.df, keys), rows.n_rows, keys, floor)


def keepers(members: DataFrame, policy: str = "first_path") -> DataFrame:
    """One row per group with the member that stays."""
    order = {
        "first_path": F.struct("path"),
        "shortest_path": F.struct(F.length("path").alias("length"), F.col("path")),
        "oldest": F.struct("modified", "path") if "modified" in members.columns else None,
    }.get(policy)
    if order is None:
        raise ValueError(f"unknown or unavailable keep policy {policy!r}")
    return members.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_files"), F.min(order)["path"].alias("keep_path")
    )


def distinct_paths(items: DataFrame) -> DataFrame:
    """One row per path, for inventories of overlapping folders: the one seen
    from the topmost folder, whose ``dirs`` are longest."""
    if "dirs" not in items.columns:
        return items.dropDuplicates(["path"])
    others = [c for c in items.columns if c != "path"]
    best = F.max_by(F.struct(*others), F.struct(F.size("dirs"), "dirs")).alias("best")
    return items.groupBy("path").agg(best).select("path", *(f"best.{c}" for c in others)).select(*items.columns)


def scan_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """How many rows (as multisets) only one of two scans has; 0, 0 when equal."""
    columns = first.columns
    tagged = first.withColumn("_side", F.lit(1)).unionByName(second.select(*columns).withColumn("_side", F.lit(-1)))
    balance = tagged.groupBy(*columns).agg(F.sum("_side").alias("_balance"))
    return balance.agg(
        F.coalesce(F.sum(F.greatest("_balance", F.lit(0))), F.lit(0)).alias("only_first"),
        F.coalesce(F.sum(F.greatest(-F.col("_balance"), F.lit(0))), F.lit(0)).alias("only_second"),
    )
