"""Any DataFrame as a corpus.

Items have the columns ``path, name, dirs, size_bytes, is_symlink, content``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentdup.functions.paths import base_name, dir_names


def table_items(
    rows: DataFrame,
    path: Column,
    content: Column,
    is_symlink: Column | None = None,
    modified: Column | None = None,
    size: Column | None = None,
) -> DataFrame:
    """Bind a table: ``path`` is any unique text id, ``content`` text or bytes.

    ``size`` is a stored byte size, if there is one: with it, size rules and
    inventories need not read the content. Rows without content stay: the
    audit calls them unreadable and a scan lists them, with a null size where
    none is stored.
    """
    columns = [
        path.alias("path"),
        base_name(path).alias("name"),
        dir_names(path).alias("dirs"),
        (F.octet_length(content) if size is None else size).cast("bigint").alias("size_bytes"),
        (F.lit(False) if is_symlink is None else is_symlink).alias("is_symlink"),
        content.cast("binary").alias("content"),
    ]
    if modified is not None:
        columns.append(modified.alias("modified"))
    return rows.select(*columns)


def binary_file_items(spark: SparkSession, folder: str) -> DataFrame:
    """Files of an object store through the built-in ``binaryFile`` reader.

    That reader leaves out empty files and names that start with ``.`` or
    ``_``, follows links, and holds at most 2 GB per file; on mounted storage
    prefer :func:`contentdup.sources.inventory.inventory`.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    )
    base = folder.rstrip("/")
    relative = F.regexp_replace("path", "^.*?" + "\\Q" + base.split(":")[-1].lstrip("/") + "\\E/", "")
    return files.select(
        "path",
        base_name(F.col("path")).alias("name"),
        dir_names(relative).alias("dirs"),
        F.col("length").alias("size_bytes"),
        F.lit(False).alias("is_symlink"),
        "content",
        F.col("modificationTime").alias("modified"),
    )
