"""One-row and per-stage aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentdup.functions.display import format_bytes
from contentdup.functions.paths import dir_path


def _total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def space_savings(groups: DataFrame) -> DataFrame:
    """Bytes in all members and bytes in all but one member of each group."""
    size, n = F.col("size_bytes"), F.col("n_files")
    return groups.agg(
        _total(size * n).alias("total_bytes"), _total(size * (n - 1)).alias("reclaimable_bytes")
    )


def scan_summary(groups: DataFrame) -> DataFrame:
    """Groups, files, bytes used and reclaimable, as numbers and as text."""
    size, n = F.col("size_bytes"), F.col("n_files")
    return groups.agg(
        F.count(F.lit(1)).alias("n_groups"),
        _total(n).alias("n_files"),
        _total(size * n).alias("total_bytes"),
        _total(size * (n - 1)).alias("reclaimable_bytes"),
    ).select(
        "*",
        format_bytes(F.col("total_bytes")).alias("total_text"),
        format_bytes(F.col("reclaimable_bytes")).alias("reclaimable_text"),
    )


def corpus_stats(digests: DataFrame) -> DataFrame:
    """Distinct contents, further copies, files, bytes and directories."""
    size, n = F.col("size_bytes"), F.col("n")
    contents = digests.groupBy("size_bytes", "digest").agg(F.count(F.lit(1)).alias("n"))
    files = contents.agg(
        F.count(F.lit(1)).alias("unique_files"), _total(n).alias("total_files"), _total(size * n).alias("total_bytes")
    ).withColumn("directories", F.lit(0).cast("bigint"))
    folders = digests.select(dir_path(F.col("path")).alias("folder")).distinct()
    counted = folders.agg(
        *(F.lit(0).cast("bigint").alias(c) for c in ("unique_files", "total_files", "total_bytes")),
        F.count("folder").alias("directories"),
    )
    # Two one-row results put together.
    both = files.unionByName(counted)
    return both.agg(*(F.sum(c).alias(c) for c in both.columns)).select(
        "unique_files",
        (F.col("total_files") - F.col("unique_files")).alias("duplicate_files"),
        "total_files",
        "total_bytes",
        "directories",
    )


def scan_funnel(digests: DataFrame) -> DataFrame:
    """Files and bytes left after each stage, from rows with both digests.

    Equal full digests imply equal candidate digests, so one count per
    ``size, candidate_digest, digest`` holds all stages.
    """
    n, size = F.col("n"), F.col("size_bytes")
    shared = F.when(n > 1, n)
    exact = digests.groupBy("size_bytes", "candidate_digest", "digest").agg(F.count(F.lit(1)).alias("n"))
    alike = exact.groupBy("size_bytes", "candidate_digest").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(shared), F.lit(0)).alias("duplicates"),
        F.count_if(n > 1).alias("groups"),
    )
    return alike.agg(
        _total(n).alias("found_files"),
        _total(n * size).alias("found_bytes"),
        _total(shared).alias("candidate_files"),
        _total(shared * size).alias("candidate_bytes"),
        _total(F.col("duplicates")).alias("duplicate_files"),
        _total(F.col("duplicates") * size).alias("duplicate_bytes"),
        _total(F.col("groups")).alias("duplicate_groups"),
    )
