"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentdup.operators.groups import join_groups
from contentdup.operators.settle import Settled, settle

# Nodes with more links than this, and more than 1/10,000 of all, are joined by
# broadcast, so that no centre of a star fills a task.
FEW_LINKS = 64


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``, any order): the
    smallest node that can be reached.

    Each round sends every node's smallest neighbour to all its neighbours
    (large star), then links every node's smaller neighbours to the smallest
    (small star), until every node has one link and no root has any. A round
    is two aggregations and joins, written to the shared folder; the driver
    sees whether any node is left.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    written = settle(edges, "links")
    edges = written.df
    while not _are_stars(edges):
        larger = settle(_larger_star(edges.union(edges.select("b", "a")), 2 * written.n_rows), "larger-links")
        written.drop()
        written = settle(_smaller_star(larger), "links")
        larger.drop()
        edges = written.df
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _are_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def _larger_star(edges: DataFrame, n_rows: int) -> DataFrame:
    """Link the larger neighbours of each ``a`` to the smallest of all, ``a``
    included. A node may have any share of the ``n_rows`` links."""
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n_files"))
    smallest = smallest.select("a", F.least("a", "m").alias("m"), "n_files")
    joined = join_groups(edges, smallest, n_rows, ["a"], FEW_LINKS)
    return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _smaller_star(links: Settled) -> DataFrame:
    """Link the smaller neighbours of each ``a`` to the smallest of them, and
    ``a`` too. A node may have any share of the links here too."""
    edges = links.df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n_files"))
    joined = join_groups(edges, smallest, links.n_rows, ["a"], FEW_LINKS)
    linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
    return linked.where("a <> b").distinct()
