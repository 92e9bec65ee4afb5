"""Corpora with known duplicates, as items or as files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentdup.operators.settle import settle


def plant_copies(items: DataFrame, folder: str = "/copies") -> DataFrame:
    """The items and one copy of each under ``folder``; content is not moved."""
    copies = items.withColumn("path", F.concat(F.lit(folder), "path")).withColumn(
        "dirs", F.array_prepend("dirs", F.lit(folder.strip("/")))
    )
    return items.unionByName(copies)


def write_files(items: DataFrame, base: str) -> DataFrame:
    """Write each item below ``base`` on mounted storage; returns the paths."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths = [os.path.join(base, path.lstrip("/")) for path in batch["path"]]
            for path, content in zip(paths, batch["content"]):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as file:
                    file.write(content)
            yield pd.DataFrame({"path": paths})

    return settle(items.select("path", "content").mapInPandas(write, "path string"), "files").df
