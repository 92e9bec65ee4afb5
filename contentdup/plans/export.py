"""Export of duplicate groups, written in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_rows(groups: DataFrame) -> DataFrame:
    """Nested records; ``part`` stays since a very large group has several."""
    return groups.select("size_bytes", "hash", "part", "paths")


def csv_rows(members: DataFrame) -> DataFrame:
    """One flat row per member."""
    return members.select("size_bytes", F.col("digest").alias("hash"), "path")


def write_json(groups: DataFrame, folder: str) -> None:
    """JSON Lines; an empty result leaves an empty folder."""
    json_rows(groups).write.mode("overwrite").json(folder)


# Values in quotes where they need them, a quote inside doubled, blanks and line
# ends kept: what any reader of CSV takes back as it was.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_csv(members: DataFrame, folder: str) -> None:
    """CSV with a header line in every file, also when there are no rows."""
    csv_rows(members).write.mode("overwrite").options(**CSV_OPTIONS).csv(folder)


def read_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of an exported folder; paths may hold line ends."""
    return spark.read.schema("size_bytes bigint, hash string, path string").options(**CSV_OPTIONS, multiLine=True).csv(folder)
