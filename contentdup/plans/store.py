"""A digest store on disk: rows bucketed by path, group counts as signed steps.

``rows`` holds one row per path, bucketed and sorted by path, so an inventory
meets it bucket by bucket: the store side of that join is read in place and
never shuffled. Every re-scan writes a new version beside the old one; the
old one stays readable until :meth:`DigestStore.clean`.

``steps`` holds, per version, how many members each (size, digest) has gained
or lost by it. A re-scan adds the keys it touched and reads none of the others;
the number of members of a group is the sum of its steps.

The step of a version is written before its rows, and a folder counts once it
has the marker that Spark writes last. So a run that dies leaves the store as
it was, and the next one writes over what it left.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentdup.operators.among import among, filter_bits
from contentdup.operators.groups import KEYS, join_groups
from contentdup.operators.settle import delete_folder, finished_folders, settle

STORE_COLUMNS = ["path", "size_bytes", "modified", "algorithm", "mode", "digest"]

# Rows per bucket that a store is made for, and bounds of the number of buckets.
ROWS_PER_BUCKET = 2_000_000
MOST_BUCKETS = 20_000
# Steps that are read one by one before they should be added up.
MANY_STEPS = 16

_VERSION = re.compile(r"^v(\d{9})-b(\d+)$")
# One step, or the sum of all up to it.
_STEP = re.compile(r"^[sw](\d{9})$")


def bucket_count(n_rows: int, least: int = 8) -> int:
    return max(least, min(MOST_BUCKETS, -(-n_rows // ROWS_PER_BUCKET)))


def latest_per_path(rows: DataFrame) -> DataFrame:
    """One row per path: of several that with the latest time of change."""
    others = ["modified", *(c for c in STORE_COLUMNS if c not in ("path", "modified"))]
    latest = F.max(F.struct(*others)).alias("latest")
    return rows.groupBy("path").agg(latest).select("path", *(f"latest.{c}" for c in STORE_COLUMNS[1:]))


@dataclass
class DigestStore:
    """A store in ``folder``. Its rows are read as a bucketed table, registered
    in the session under a name of its own."""

    spark: SparkSession
    folder: str

    @classmethod
    def create(cls, rows: DataFrame, folder: str, n_buckets: int | None = None) -> DigestStore:
        """A store in a new folder from rows with the columns of one, of which
        several may have the same path."""
        store = cls(rows.sparkSession, folder)
        once = settle(latest_per_path(rows), "store-rows")
        n_buckets = n_buckets or bucket_count(once.n_rows)
        store.write(once.df.repartition(n_buckets, "path"), once.df.select(*KEYS, F.lit(1).cast("bigint").alias("step")), n_buckets)
        return store

    def _versions(self) -> list[re.Match]:
        return finished_folders(self.spark, f"{self.folder}/rows", _VERSION)

    @property
    def version(self) -> int:
        """The number of the newest version, 0 before the first."""
        versions = self._versions()
        return int(versions[-1].group(1)) if versions else 0

    def rows(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        chosen = [m for m in self._versions() if version in (None, int(m.group(1)))]
        if not chosen:
            raise ValueError(f"no such version of the store in {self.folder}: {version}")
        name, n_buckets = chosen[-1].group(0), int(chosen[-1].group(2))
        table = f"digest_store_{uuid.uuid4().hex}"
        modified = self.spark.read.parquet(f"{self.folder}/rows/{name}").schema["modified"].dataType.simpleString()
        types = {"size_bytes": "bigint", "modified": modified}
        columns = ", ".join(f"{c} {types.get(c, 'string')}" for c in STORE_COLUMNS)
        location = f"{self.folder}/rows/{name}".replace("'", "''")
        self.spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet "
            f"CLUSTERED BY (path) SORTED BY (path) INTO {n_buckets} BUCKETS LOCATION '{location}'"
        )
        return self.spark.table(table)

    @property
    def n_buckets(self) -> int | None:
        versions = self._versions()
        return int(versions[-1].group(2)) if versions else None

    def write(self, rows: DataFrame, steps: DataFrame, n_buckets: int) -> None:
        """The next version: its rows, one per path, and the signed counts of
        the keys that it changes. Rows that already lie by path in
        ``n_buckets`` partitions are written where they are."""
        number = self.version + 1
        summed = steps.groupBy(*KEYS).agg(F.sum("step").alias("step")).where("step <> 0")
        summed.write.mode("overwrite").parquet(f"{self.folder}/steps/s{number:09d}")
        location = f"{self.folder}/rows/v{number:09d}-b{n_buckets}"
        table = f"digest_store_{uuid.uuid4().hex}"
        # What a run that died has left under this number.
        delete_folder(self.spark, location)
        writer = rows.select(*STORE_COLUMNS).write.format("parquet").bucketBy(n_buckets, "path").sortBy("path")
        writer.option("path", location).saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files stay

    def _steps(self) -> list[str]:
        """Folders whose rows make up the counts: the newest sum, if there is
        one, and all steps after it up to the newest version."""
        names = [m.group(0) for m in finished_folders(self.spark, f"{self.folder}/steps", _STEP) if int(m.group(1)) <= self.version]
        whole = max((n for n in names if n.startswith("w")), default="w000000000", key=lambda n: n[1:])
        return [n for n in names if n == whole or (n.startswith("s") and n[1:] > whole[1:])]

    def _read_steps(self, names: list[str]) -> DataFrame:
        schema = "size_bytes bigint, digest string, step bigint"
        paths = [f"{self.folder}/steps/{name}" for name in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def counts(self) -> DataFrame:
        """``size_bytes, digest, n_files`` of all contents, single ones too."""
        summed = self._read_steps(self._steps()).groupBy(*KEYS).agg(F.sum("step").alias("n_files"))
        return summed.where("n_files > 0")

    def groups(self) -> DataFrame:
        """Groups of two or more members, from the steps alone."""
        return self.counts().where("n_files > 1")

    def touched_groups(self) -> DataFrame:
        """Keys whose counts the newest version has changed, with ``n_before``
        and ``n_files``. Rows of other keys are ruled out as they are read."""
        last = self._read_steps([f"s{self.version:09d}"])
        steps = self._read_steps(self._steps())
        near = among(steps, last, filter_bits(last.count()), KEYS)
        totals = near.groupBy(*KEYS).agg(F.sum("step").alias("n_files"))
        return last.join(totals, KEYS).select(*KEYS, (F.col("n_files") - F.col("step")).alias("n_before"), "n_files")

    def members(self, floor: int | None = None) -> DataFrame:
        """Rows of all groups, with counts from the steps."""
        rows = self.rows()
        return join_groups(rows, self.groups(), rows.count(), floor=floor)

    def clean(self, keep_steps: int = MANY_STEPS) -> None:
        """Drop all versions but the newest; add the steps up if they are more
        than ``keep_steps``."""
        for match in self._versions()[:-1]:
            delete_folder(self.spark, f"{self.folder}/rows/{match.group(0)}")
        if len(self._steps()) > keep_steps:
            self.counts().select(*KEYS, F.col("n_files").alias("step")).write.mode("overwrite").parquet(
                f"{self.folder}/steps/w{self.version:09d}"
            )
            for match in finished_folders(self.spark, f"{self.folder}/steps", _STEP):
                # The step of the newest version says what it has changed.
                if match.group(0) not in (f"w{self.version:09d}", f"s{self.version:09d}"):
                    delete_folder(self.spark, f"{self.folder}/steps/{match.group(0)}")
