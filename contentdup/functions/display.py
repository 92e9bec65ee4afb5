"""Column expressions for human-readable output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names of the size text, each 1024 times the one before.
UNITS = ("bytes", "KB", "MB", "GB", "TB", "PB")


def format_bytes(size: Column) -> Column:
    """``1536`` -> ``1.5 KB``; one decimal, ties to even, negatives in bytes."""
    number = size.cast("double")
    text = None
    for power, unit in enumerate(UNITS):
        scaled = F.format_string(f"%.1f {unit}", F.bround(number / F.lit(float(1024**power)), 1))
        if unit == UNITS[-1]:
            return text.otherwise(scaled)
        below = number < F.lit(float(1024 ** (power + 1)))
        text = F.when(below, scaled) if text is None else text.when(below, scaled)


def short_digest(digest: Column) -> Column:
    return F.concat(F.substring(digest, 1, 8), F.lit("..."))


def display_digest(digest: Column) -> Column:
    return F.concat(F.substring(digest, 1, 8), F.lit("..."), F.right(digest, F.lit(8)))
