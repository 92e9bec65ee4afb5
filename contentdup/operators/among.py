"""Rows whose key may be in a set of keys, found without moving the rows.

The keys become a bit table of bounded size that is sent to all tasks. A row
that it rules out is certainly not in the set; the others have to be matched
exactly, but they are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds of the bit table: 128 KiB to 128 MiB.
FEWEST_BITS, MOST_BITS = 1 << 20, 1 << 30
BITS_PER_KEY = 16


def filter_bits(n_keys: int) -> int:
    """Bits for a table that lets about one foreign row in sixteen through; past
    the largest table more rows pass, and the exact match after it is larger."""
    return max(FEWEST_BITS, min(MOST_BITS, 1 << max(n_keys * BITS_PER_KEY - 1, 1).bit_length()))


def _slot(columns: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(bits))


def _with_mark(items: DataFrame, keys: DataFrame, columns: list[str], bits: int, how: str) -> DataFrame:
    """Items with the bit ``_marked`` (null: its part of the table has no bit)."""
    slots = keys.select(_slot(columns, bits).alias("slot"))
    table = slots.groupBy(F.bitmap_bucket_number("slot").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_marks")
    )
    slot = _slot(columns, bits)
    placed = items.withColumns({"_bucket": F.bitmap_bucket_number(slot), "_place": F.bitmap_bit_position(slot)})
    byte = F.conv(F.hex(F.substring("_marks", (F.floor(F.col("_place") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    weight = F.expr("pow(2, _place % 8)").cast("int")
    met = placed.join(F.broadcast(table), "_bucket", how)
    return met.select(*items.columns, ((F.floor(byte / weight) % 2) == 1).alias("_marked"))


def among(items: DataFrame, keys: DataFrame, bits: int = 1 << 26, columns: str | list[str] = "path") -> DataFrame:
    """Items whose ``columns`` may be those of a row of ``keys``."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    return _with_mark(items, keys, columns, bits, "inner").where("_marked").drop("_marked")


def without(items: DataFrame, keys: DataFrame, n_keys: int, columns: str | list[str] = "path") -> DataFrame:
    """Items whose ``columns`` no row of ``keys`` has, nulls included.

    Only items that the bit table does not rule out go into the exact join, so
    of wide rows few are moved however many keys there are.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    marked = _with_mark(items, keys, columns, filter_bits(n_keys), "left")
    clear = marked.where(~F.coalesce("_marked", F.lit(False))).drop("_marked")
    doubtful = among(items, keys, filter_bits(n_keys), columns)
    # Spark would move an anti-join below the bit table, and all items with it.
    met = doubtful.join(keys.select(*columns).distinct().withColumn("_met", F.lit(True)), columns, "left")
    return clear.unionByName(met.where(F.col("_met").isNull()).select(*items.columns))
