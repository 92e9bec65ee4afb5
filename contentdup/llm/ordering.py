"""Positions inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentdup.operators.settle import settle


def carried(totals: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per piece, what the group it begins with has in earlier pieces; at most
    one row per piece, as only its first group can come from before."""
    earlier = W.partitionBy(key).orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("piece", key, *(F.sum(c).over(earlier).alias(f"{c}_before") for c in columns)).where(
        F.col(f"{columns[0]}_before").isNotNull()
    )


def number_within(rows: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """Rows with ``piece`` and ``pos``, from 1 in each ``key`` by ``order``.

    Rows are range-partitioned, so a large group spreads over several pieces;
    each counts its own rows. ``key`` must not be null.
    """
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = settle(ranged.withColumn("row_slot", F.monotonically_increasing_id()), label).df
    placed = placed.withColumn("piece", F.shiftright("row_slot", 33))
    totals = placed.groupBy("piece", key).agg(F.count(F.lit(1)).alias("n"), F.min("row_slot").alias("first"))
    before = totals.join(F.broadcast(carried(totals, key, ["n"])), ["piece", key], "left")
    starts = before.select("piece", key, (F.col("first") - F.coalesce("n_before", F.lit(0)) - 1).alias("start"))
    return placed.join(starts, ["piece", key]).withColumn("pos", F.col("row_slot") - F.col("start")).drop("row_slot", "start")
