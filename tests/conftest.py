import os
import sys

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from contentdup.sources.tables import table_items  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def corpus(spark):
    """Items from ``{path: bytes}``."""

    def build(files):
        rows = spark.createDataFrame(list(files.items()), "path string, content binary")
        return table_items(rows, F.col("path"), F.col("content"))

    return build


def flat(members):
    """``{(size, digest-free group of paths)}`` for comparison."""
    groups = {}
    for row in members.collect():
        groups.setdefault((row.size_bytes, row.digest), set()).add(row.path)
    return {(size, frozenset(paths)) for (size, _), paths in groups.items()}


def expected_groups(files, compared=lambda content: content):
    groups = {}
    for path, content in files.items():
        groups.setdefault((len(content), compared(content)), set()).add(path)
    return {(size, frozenset(paths)) for (size, _), paths in groups.items() if len(paths) > 1}
