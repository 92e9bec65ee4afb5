"""Re-scan with stored digests: only new or changed items are digested.

The store has the columns ``path, size_bytes, modified, algorithm, mode,
digest``: a DataFrame, or a :class:`contentdup.plans.store.DigestStore`, which
is met in place and gets a new version. A stored row is valid while path, size
and time of change are the same and the digest was made the same way. Without
a time of change an item counts as changed. ``version`` names another column of
the items that changes with their content; its values are stored in place of
the time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentdup.operators.among import among, filter_bits
from contentdup.operators.filters import keep_known_and_unknown
from contentdup.operators.groups import KEYS, shared_rows
from contentdup.operators.settle import Settled, settle
from contentdup.plans.scan import digest_outcomes
from contentdup.plans.store import STORE_COLUMNS, DigestStore, bucket_count, latest_per_path
from contentdup.sources.content import read_digests
from contentdup.spec import ScanSpec


def stored_mode(spec: ScanSpec) -> str:
    """How a digest was made, as far as it changes the value."""
    if spec.mode == "quick":
        return f"prefix:{spec.prefix_bytes}"
    return "whole" if spec.verify or spec.mode == "full" else "regions"


def store_rows(digests: DataFrame, spec: ScanSpec, version: str = "modified") -> DataFrame:
    modified = F.col(version) if version in digests.columns else F.lit(None).cast("timestamp")
    return digests.select(
        "path",
        "size_bytes",
        modified.alias("modified"),
        F.lit(spec.algorithm).alias("algorithm"),
        F.lit(stored_mode(spec)).alias("mode"),
        "digest",
    )


@dataclass
class Rescan:
    """The new store, what has become of the items, and what could not be read.

    ``differing``: items without a valid stored row, and stored rows without an
    item, as ``path, state, size_bytes, modified, old_size, old_digest`` with
    the states ``new``, ``changed`` and ``gone``. ``digested``: the new digests.
    ``unreadable``: ``path, error`` of new or changed items without a digest.
    """

    store: Settled | DigestStore
    differing: Settled
    outcomes: Settled

    @property
    def fresh(self) -> DataFrame:
        return self.differing.df.where("state <> 'gone'")

    @property
    def digested(self) -> DataFrame:
        return self.outcomes.df.where("error IS NULL").drop("error")

    @property
    def unreadable(self) -> DataFrame:
        return self.outcomes.df.where("error IS NOT NULL").select("path", "error")

    @property
    def n_fresh(self) -> int:
        return self.fresh.count()

    @property
    def n_digested(self) -> int:
        return self.digested.count()

    def members(self, floor: int | None = None) -> DataFrame:
        return self.store.members(floor) if isinstance(self.store, DigestStore) else shared_rows(self.store, floor=floor)


def differences(found: DataFrame, old: DataFrame, spec: ScanSpec) -> DataFrame:
    """Where inventory and store differ. Both go by path; a bucketed store is
    read bucket by bucket, only the inventory is moved."""
    stored = old.select("path", *(F.col(c).alias(f"old_{c}") for c in STORE_COLUMNS[1:]))
    made_alike = (F.col("old_algorithm") == spec.algorithm) & (F.col("old_mode") == stored_mode(spec))
    same = made_alike & (F.col("size_bytes") == F.col("old_size_bytes")) & (F.col("modified") == F.col("old_modified"))
    state = (
        F.when(F.col("found").isNull(), "gone").when(F.col("old_mode").isNull(), "new").when(F.coalesce(same, F.lit(False)), "same")
    )
    met = found.withColumn("found", F.lit(True)).join(stored, "path", "full_outer").withColumn("state", state.otherwise("changed"))
    return met.where("state <> 'same'").select(
        "path", "state", "size_bytes", "modified", F.col("old_size_bytes").alias("old_size"), "old_digest"
    )


def _renew(store: DataFrame | DigestStore, old: DataFrame, differing: Settled, outcomes: Settled, spec: ScanSpec) -> Rescan:
    """The next state of the store: rows that still hold, and the new digests."""
    kept = old.join(differing.df.select("path"), "path", "left_anti")
    done = outcomes.df.where("error IS NULL")
    renewed = store_rows(done, spec)
    if not isinstance(store, DigestStore):
        return Rescan(settle(kept.select(*STORE_COLUMNS).unionByName(renewed), "digest-store", compact=True), differing, outcomes)
    lost = differing.df.where("old_digest IS NOT NULL").select(
        F.col("old_size").alias("size_bytes"), F.col("old_digest").alias("digest"), F.lit(-1).cast("bigint").alias("step")
    )
    gained = done.select(*KEYS, F.lit(1).cast("bigint").alias("step"))
    n_buckets = store.n_buckets or bucket_count(outcomes.n_rows)
    # The kept rows are written where they lie; only the new ones go by path.
    rows = kept.select(*STORE_COLUMNS).unionByName(renewed.repartition(n_buckets, "path"))
    store.write(rows, lost.unionByName(gained), n_buckets)
    return Rescan(store, differing, outcomes)


def _stored(store: DataFrame | DigestStore, found: DataFrame) -> DataFrame:
    if not isinstance(store, DigestStore):
        return latest_per_path(store)
    if store.version:
        return store.rows()
    types = {"size_bytes": "bigint", "modified": found.schema["modified"].dataType.simpleString()}
    return store.spark.createDataFrame([], ", ".join(f"{c} {types.get(c, 'string')}" for c in STORE_COLUMNS))


def rescan_items(
    items: DataFrame, store: DataFrame | DigestStore, spec: ScanSpec = ScanSpec(), version: str = "modified"
) -> Rescan:
    """Re-scan rows that carry their content.

    Pays off when sizes are stored with the rows (``size`` of
    :func:`contentdup.sources.tables.table_items`), else finding what changed
    reads all content once. Content is neither moved nor digested for items
    that the filter of new paths rules out; the narrow digests are matched
    exactly. Items without content or size are listed in ``unreadable``, and
    looked at again by the next re-scan.
    """
    column = F.col(version) if version in items.columns else F.lit(None).cast("timestamp")
    items = items.withColumn("modified", column)
    found = keep_known_and_unknown(items, spec).select("path", "size_bytes", "modified")
    old = _stored(store, found)
    differing = settle(differences(found, old, spec), "differing")
    fresh = differing.df.where("state <> 'gone'").select("path")
    near = digest_outcomes(among(items, fresh, filter_bits(differing.n_rows)), spec)
    outcomes = settle(near.join(fresh, "path", "left_semi"), "digests")
    return _renew(store, old, differing, outcomes, spec)


def rescan_files(found: DataFrame, store: DataFrame | DigestStore, spec: ScanSpec = ScanSpec()) -> Rescan:
    """Re-scan an inventory; only new or changed files are opened. What the
    inventory could not list, or is not readable now, is in ``unreadable``."""
    sized = keep_known_and_unknown(found, spec)
    sized = sized.select("path", "size_bytes", "modified", *(["error"] if "error" in found.columns else []))
    entries = settle(sized, "entries").df
    old = _stored(store, entries)
    differing = settle(differences(entries.select("path", "size_bytes", "modified"), old, spec), "differing")
    how = spec.mode if stored_mode(spec) != "whole" else "whole"
    todo = settle(differing.df.where("state <> 'gone' AND size_bytes IS NOT NULL").select("path", "size_bytes", "modified"), "to-read")
    read = read_digests(todo.df, how, spec.prefix_bytes, spec.algorithm)
    if "error" in entries.columns:
        read = read.unionByName(entries.where("error IS NOT NULL"), allowMissingColumns=True)
    return _renew(store, old, differing, settle(read, "digests"), spec)
