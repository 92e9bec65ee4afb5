"""Streams of arriving items: digests into a store, and duplicates as they come."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contentdup.operators.groups import KEYS, join_groups
from contentdup.operators.settle import delete_folder, finished_folders, settle
from contentdup.plans.rescan import store_rows
from contentdup.plans.scan import digest_items
from contentdup.plans.store import STORE_COLUMNS
from contentdup.spec import ScanSpec


def ingest(items: DataFrame, store: str, checkpoint: str, spec: ScanSpec = ScanSpec(), **trigger) -> StreamingQuery:
    """Digest arriving items into the store, one folder per stream and batch.

    A stream is known by the id that Spark keeps in its checkpoint, so a
    stream with a new checkpoint adds to the store. A repeated micro-batch
    overwrites its own folder, so rows are stored once. The stream keeps no
    state: grouping reads the store. ``ingested`` is the time of the batch.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        rows = store_rows(digest_items(batch, spec), spec).withColumn("ingested", F.current_timestamp())
        rows.write.mode("overwrite").parquet(f"{store}/stream={stream}/batch={batch_id}")

    return (
        items.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The latest row of each path in a store that :func:`ingest` fills: by
    time of ingest, then batch; within a batch by time of change."""
    values = [c for c in STORE_COLUMNS if c not in ("path", "modified")]
    latest = F.max(F.struct("ingested", "batch", "modified", *values))
    return (
        spark.read.parquet(store)
        .groupBy("path")
        .agg(latest.alias("latest"))
        .select("path", *(f"latest.{c}" for c in STORE_COLUMNS if c != "path"))
    )


_STATE = "size_bytes bigint, digest string, first_at timestamp, first_path string, last_at timestamp"
_BATCH = re.compile(r"^b(\d{9})$")
# Versions of the state that stay: the one a repeated batch starts from, and its result.
_KEPT_STATES = 2


@dataclass
class Arrivals:
    """Duplicates among arriving items, found batch by batch.

    ``folder`` holds, per micro-batch, ``found`` (``path, size_bytes, digest,
    arrived, duplicate_of, late``) and ``state``: one row per content with its
    first item and the time it was last seen. The state forgets contents not
    seen for ``within`` (an interval) before the watermark, so it grows with
    what arrives in that time and not with the stream. An item that arrives
    behind the watermark of the batches before is ``late``; it is listed, and
    compared with what the state still knows, but not remembered.

    The state of a batch is a version of its own, made from that of the batch
    before. A batch that Spark repeats after a failure starts from the same
    version and writes over what it left, so every item is counted once.
    """

    spark: SparkSession
    folder: str
    within: str = "1 day"
    floor: int | None = None

    def _states(self) -> list[int]:
        return [int(m.group(1)) for m in finished_folders(self.spark, f"{self.folder}/state", _BATCH)]

    def _state(self, before: int) -> tuple[DataFrame, DataFrame]:
        """The state that ``before`` starts from, and the latest time seen."""
        numbers = [n for n in self._states() if n < before]
        if not numbers:
            return self.spark.createDataFrame([], _STATE), self.spark.createDataFrame([], "latest timestamp")
        name = f"b{max(numbers):09d}"
        return (
            self.spark.read.schema(_STATE).parquet(f"{self.folder}/state/{name}"),
            self.spark.read.schema("latest timestamp").parquet(f"{self.folder}/clock/{name}"),
        )

    def take(self, items: DataFrame, number: int) -> None:
        """One micro-batch of ``path, size_bytes, digest, arrived``."""
        name = f"b{number:09d}"
        known, clock = self._state(number)
        rows = settle(items.select("path", *KEYS, "arrived"), "arrived")
        seen = clock.agg(F.max("latest").alias("latest")).first().latest
        wait = F.expr(f"INTERVAL '{self.within}'")
        late = F.lit(False) if seen is None else F.col("arrived") < F.lit(seen) - wait
        marked = rows.df.withColumn("late", F.coalesce(late, F.lit(True)))

        # One row per content of the batch; counts combine before the shuffle.
        order = F.struct("arrived", "path")
        first = F.min(F.when(~F.col("late"), order))
        fresh = marked.groupBy(*KEYS).agg(
            F.count(F.lit(1)).alias("n_files"), first.alias("first"), F.max(F.when(~F.col("late"), F.col("arrived"))).alias("seen_at")
        )
        met = fresh.join(known, KEYS, "full_outer").select(
            *KEYS,
            "n_files",
            # Known contents keep their first item.
            F.coalesce("first_at", F.col("first.arrived")).alias("first_at"),
            F.coalesce("first_path", F.col("first.path")).alias("first_path"),
            F.greatest("last_at", "seen_at").alias("last_at"),
        )
        contents = settle(met, "arrived-contents")
        now = marked.agg(F.max("arrived").alias("latest")).unionByName(clock).agg(F.max("latest").alias("latest"))
        now.write.mode("overwrite").parquet(f"{self.folder}/clock/{name}")
        latest = self.spark.read.parquet(f"{self.folder}/clock/{name}").first().latest

        groups = contents.df.where("n_files IS NOT NULL").select(*KEYS, "n_files", "first_path")
        placed = join_groups(marked, groups, rows.n_rows, floor=self.floor)
        found = placed.where(F.col("late") | (F.col("path") != F.col("first_path"))).select(
            "path", *KEYS, "arrived", F.nullif("first_path", "path").alias("duplicate_of"), "late"
        )
        found.write.mode("overwrite").parquet(f"{self.folder}/found/{name}")
        kept = contents.df.where("first_path IS NOT NULL").drop("n_files")
        if latest is not None:
            kept = kept.where(F.col("last_at") >= F.lit(latest) - wait)
        # Written last: with it the batch is done.
        kept.write.mode("overwrite").parquet(f"{self.folder}/state/{name}")
        for old in [n for n in self._states() if n < number][: -_KEPT_STATES + 1]:
            for part in ("state", "clock"):
                delete_folder(self.spark, f"{self.folder}/{part}/b{old:09d}")
        contents.drop()
        rows.drop()

    @property
    def found(self) -> DataFrame:
        """All duplicates and late items so far."""
        names = [m.group(0) for m in finished_folders(self.spark, f"{self.folder}/found", _BATCH)]
        schema = "path string, size_bytes bigint, digest string, arrived timestamp, duplicate_of string, late boolean"
        paths = [f"{self.folder}/found/{name}" for name in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @property
    def state(self) -> DataFrame:
        return self._state(max(self._states(), default=-1) + 1)[0]


def find_arriving(
    items: DataFrame, arrivals: Arrivals, checkpoint: str, spec: ScanSpec = ScanSpec(), arrived: str = "arrived", **trigger
) -> StreamingQuery:
    """Find duplicates while items arrive; ``arrived`` is a column with their
    time. Digests are computed inside the micro-batch, only narrow rows meet
    the state."""

    def take(batch: DataFrame, number: int) -> None:
        digests = digest_items(batch.withColumn("modified", F.col(arrived)), spec)
        arrivals.take(digests.withColumnRenamed("modified", "arrived"), number)

    return (
        items.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
