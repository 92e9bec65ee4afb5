"""Inventories of a folder tree on storage that every executor mounts.

One Spark job per directory level: the folders of a level are dealt out over
the tasks, and file sizes are read in a second step after a shuffle, so neither
a deep subtree nor one huge folder stays with a task. All entries but
directories are listed, links included (never followed). What cannot be listed
or has a name that is no text is a row with ``error``.

Folders of an object store (any other scheme than ``file``) are listed by the
built-in ``binaryFile`` reader instead, within its limits; their content is
not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentdup.operators.settle import settle
from contentdup.ship import ship
from contentdup.sources.tables import binary_file_items
from contentdup.spec import ScanSpec

_STATED = "path string, name string, dirs array<string>, size_bytes bigint, is_symlink boolean, micros bigint, error string"
_BATCH_ROWS = 10_000


def _stat(path: str):
    """Size and time of change in microseconds since 1970, which fit 64 bits for
    any year that a file system can hold."""
    try:
        found = os.lstat(path)
        return found.st_size, found.st_mtime_ns // 1000, None
    except (OSError, ValueError, OverflowError) as problem:
        return None, None, str(problem)


_LISTED = "path string, name string, dirs array<string>, is_symlink boolean, is_dir boolean, error string"


def _as_text(name: str) -> str:
    """The name, with bytes that are no UTF-8 shown as escapes."""
    return os.fsencode(name).decode("utf-8", "backslashreplace")


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def frame(rows):
        return pd.DataFrame(rows, columns=["path", "name", "dirs", "is_symlink", "is_dir", "error"])

    rows = []
    for batch in batches:
        for folder, dirs in zip(batch["path"], batch["dirs"]):
            dirs = list(dirs)
            try:
                with os.scandir(folder) as entries:
                    for entry in entries:
                        is_link = entry.is_symlink()
                        is_dir = not is_link and entry.is_dir(follow_symlinks=False)
                        name = _as_text(entry.name)
                        if name == entry.name:
                            rows.append((entry.path, name, dirs, is_link, is_dir, None))
                        else:
                            problem = "the name is not valid UTF-8"
                            rows.append((_as_text(entry.path), name, dirs, is_link, False, problem))
                        if len(rows) == _BATCH_ROWS:
                            yield frame(rows)
                            rows = []
            except OSError as problem:
                rows.append((folder, os.path.basename(folder), dirs[:-1], False, False, str(problem)))
    if rows:
        yield frame(rows)


def _stat_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [
            (None, None, error) if error is not None else _stat(path)
            for path, error in zip(batch["path"], batch["error"])
        ]
        size, modified, error = zip(*found) if found else ((), (), ())
        yield batch.assign(
            size_bytes=pd.array(size, dtype="Int64"),
            micros=pd.array(modified, dtype="Int64"),
            error=list(error),
        )[["path", "name", "dirs", "size_bytes", "is_symlink", "micros", "error"]]


def _by_levels(spark: SparkSession, base: str, spec: ScanSpec, per_task: int = 64) -> DataFrame:
    base = os.path.realpath(base)
    if not os.path.isdir(base):
        raise ValueError(f"not a folder: {base}")
    frontier = spark.createDataFrame([(base, [])], "path string, dirs array<string>")
    n_folders, levels = 1, []
    while n_folders:
        tasks = -(-n_folders // per_task)
        listed = settle(
            frontier.repartition(tasks, "path").mapInPandas(_list_folders, _LISTED), "level"
        ).df
        levels.append(listed.where("NOT is_dir").drop("is_dir"))
        folders = listed.where("is_dir")
        if spec.exclude_dirs:
            folders = folders.where(~F.col("name").isin(*spec.exclude_dirs))
        if spec.exclude_hidden:
            folders = folders.where(~F.col("name").startswith("."))
        frontier = folders.select("path", F.array_append("dirs", F.col("name")).alias("dirs"))
        n_folders = frontier.count()
    files = levels[0]
    for level in levels[1:]:
        files = files.unionByName(level)
    tasks = max(spark.sparkContext.defaultParallelism, -(-files.count() // 100_000))
    stated = files.repartition(tasks, "path").mapInPandas(_stat_files, _STATED)
    # Made in the JVM, whose timestamps hold years that those of Python do not.
    modified = F.timestamp_micros("micros").alias("modified")
    return stated.select("path", "name", "dirs", "size_bytes", "is_symlink", modified, "error")


def mounted_path(folder: str) -> str | None:
    """The plain path of a mounted folder, None for an object store."""
    scheme, colon, rest = folder.partition(":")
    if not colon or "/" in scheme:
        return folder
    return "/" + rest.lstrip("/") if scheme == "file" else None


def outer_folders(bases: list[str], spec: ScanSpec | None = None) -> list[str]:
    """The folders that no other one of them holds, each once. A folder that
    the other would not enter, by the rules of ``spec`` or of the reader of
    object stores, stays."""
    spec = spec or ScanSpec()

    def place(base: str) -> str:
        mounted = mounted_path(base)
        return base.rstrip("/") if mounted is None else os.path.realpath(mounted)

    def enters(outer: str, inner: str) -> bool:
        if not inner.startswith(outer.rstrip("/") + "/"):
            return False
        below = inner[len(outer.rstrip("/")) + 1 :].split("/")
        hidden = (".", "_") if ":" in outer.partition("/")[0] else (".",) if spec.exclude_hidden else ()
        return not any(name in spec.exclude_dirs or name.startswith(hidden) for name in below)

    places = list(dict.fromkeys(map(place, bases)))
    return [inner for inner in places if not any(enters(outer, inner) for outer in places if outer != inner)]


def _by_listing(spark: SparkSession, base: str) -> DataFrame:
    return binary_file_items(spark, base).drop("content").withColumn("error", F.lit(None).cast("string"))


def inventory(
    spark: SparkSession, bases: str | list[str], spec: ScanSpec | None = None
) -> DataFrame:
    """Files below one or several folders, one row per path.

    Links in the names of the folders themselves are resolved, and a folder
    inside another one is left out before listing, so that no file is listed
    twice.

    Of ``spec`` only the directory rules apply here, to save entering pruned
    subtrees; apply :func:`contentdup.operators.filters.keep_items` for all.
    """
    spec = spec or ScanSpec()
    ship(spark)
    bases = [bases] if isinstance(bases, str) else list(bases)
    trees = [
        _by_listing(spark, base) if mounted_path(base) is None else _by_levels(spark, mounted_path(base), spec)
        for base in outer_folders(bases, spec)
    ]
    return reduce(DataFrame.unionByName, trees)
