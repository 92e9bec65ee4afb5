"""Write an intermediate result once and go on from the written table.

Content is read and digested in one pass; what follows (counting, joining
back, numbering) needs the narrow result several times. The table lies in
the shared folder that ``spark.checkpoint.dir`` names, so it outlives the
executors that wrote it.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    # Local mode without a setting: one folder per application.
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="contentdup-")
    return _local_folders[application]


_local_folders: dict[str, str] = {}


def file_system(spark: SparkSession, folder: str):
    """The file system of a folder, and the folder as one of its paths."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def delete_folder(spark: SparkSession, folder: str) -> None:
    files, path = file_system(spark, folder)
    files.delete(path, True)


def finished_folders(spark: SparkSession, folder: str, name: re.Pattern) -> list[re.Match]:
    """Folders below ``folder`` that were written to the end, in order of the
    number in their name."""
    files, path = file_system(spark, folder)
    if not files.exists(path):
        return []
    found = []
    for status in files.listStatus(path):
        match = name.match(status.getPath().getName())
        if match and files.exists(file_system(spark, f"{folder}/{match.group(0)}/_SUCCESS")[1]):
            found.append(match)
    return sorted(found, key=lambda match: int(match.group(1)))


@dataclass
class Settled:
    """A written table: the frame that reads it and, on demand, its row count.

    ``observed`` are figures that the writing job itself has counted.
    """

    df: DataFrame
    folder: str
    observed: Observation | None = None
    _count: list[int] = field(default_factory=list)

    @property
    def figures(self) -> dict[str, int]:
        return {name: value or 0 for name, value in self.observed.get.items()} if self.observed else {}

    @property
    def n_rows(self) -> int:
        if not self._count:
            counted = self.figures.get("n_rows")
            self._count.append(self.df.count() if counted is None else counted)
        return self._count[0]

    def drop(self) -> None:
        """Delete the table; frames made from it end with it."""
        delete_folder(self.df.sparkSession, self.folder)

    def __enter__(self) -> Settled:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def settle(
    df: DataFrame, label: str, compact: bool = False, figures: dict[str, Column] | None = None, parts: str | None = None
) -> Settled:
    """Write ``df`` and read it back.

    ``compact`` evens out the many small outputs of a wide scan first. Rows go
    by path, so a repeated task sends each row where it went before.
    ``figures`` are sums that are counted while the table is written, in the
    tasks that write it. ``parts`` names a column by whose values the table is
    split into folders.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/contentdup/{label}-{uuid.uuid4().hex}"
    rows = df.hint("rebalance", "path") if compact else df
    observed = Observation() if figures else None
    if observed:
        rows = rows.observe(observed, *(column.alias(name) for name, column in figures.items()))
    writer = rows.write.partitionBy(parts) if parts else rows.write
    writer.parquet(folder)
    schema = df.schema
    if parts:  # the values of this column are names of folders
        schema = StructType([f for f in schema if f.name != parts] + [schema[parts]])
    return Settled(spark.read.schema(schema).parquet(folder), folder, observed)
