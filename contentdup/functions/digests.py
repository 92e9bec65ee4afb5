"""Digest expressions over a binary content column.

``sha2`` stays in the JVM. ``blake2b`` crosses to Python in Arrow batches,
after the JVM has cut the bytes that are to be digested.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from contentdup.spec import REGION_BYTES, REGION_MIN_BYTES

# Sizes up to the first bound are read whole (-1), then each
# bound has the prefix length that applies up to it, the last one to the rest.
WHOLE_UP_TO = 8192
PREFIX_TIERS = ((1024 * 1024, 16 * 1024), (100 * 1024 * 1024, 32 * 1024))
LARGEST_PREFIX = 64 * 1024


@F.pandas_udf(StringType())
def _blake2b(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else hashlib.blake2b(b).hexdigest())


def digest_bytes(content: Column, algorithm: str = "sha2") -> Column:
    """Lower-case hex digest of all bytes of ``content``."""
    return _blake2b(content) if algorithm == "blake2b" else F.sha2(content, 256)


def prefix_length(size: Column) -> Column:
    """Bytes an adaptive prefix digest covers; -1 stands for the whole content."""
    tier = F.when(size <= WHOLE_UP_TO, F.lit(-1))
    for bound, length in PREFIX_TIERS:
        tier = tier.when(size <= bound, F.lit(length))
    return tier.otherwise(F.lit(LARGEST_PREFIX))


def fixed_prefix(content: Column, length: int) -> Column:
    return F.substring(content, 1, length)


def adaptive_prefix(content: Column, size: Column) -> Column:
    return F.when(prefix_length(size) == -1, content).otherwise(
        F.substring(content, F.lit(1), prefix_length(size))
    )


def three_regions(content: Column, size: Column) -> Column:
    """First, middle and last 4 KiB of large content, else the adaptive prefix."""
    middle = F.floor(size / 2) - REGION_BYTES // 2
    last = size - REGION_BYTES
    parts = [
        F.substring(content, (start + 1).cast("int"), F.lit(REGION_BYTES))
        for start in (F.lit(0), middle, last)
    ]
    return F.when(size > REGION_MIN_BYTES, F.concat(*parts)).otherwise(adaptive_prefix(content, size))


def candidate_bytes(content: Column, size: Column, mode: str, prefix: int) -> Column:
    """The bytes that the first stage of a scan in ``mode`` compares."""
    if mode == "quick":
        return fixed_prefix(content, prefix)
    if mode == "multi_region":
        return three_regions(content, size)
    return adaptive_prefix(content, size)
