"""The scans: filter, digest, group.

Content never enters a shuffle. Where it lies in the rows, one pass reads it
and leaves ``path, size_bytes, digest``; where it lies in files, sizes and
then prefixes decide which files are opened at all.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentdup.functions.digests import PREFIX_TIERS, candidate_bytes, digest_bytes
from contentdup.operators.filters import audit_reason, in_size_range, keep_items, keep_known_and_unknown
from contentdup.operators.groups import KEYS, count_groups, join_groups, rows_and_bytes, shared_rows
from contentdup.operators.settle import Settled, settle
from contentdup.sources.content import read_digests
from contentdup.sources.inventory import inventory, mounted_path, outer_folders
from contentdup.sources.tables import binary_file_items
from contentdup.spec import REGION_MIN_BYTES, ScanSpec


def _first_digest(spec: ScanSpec):
    content, size = F.col("content"), F.col("size_bytes")
    return digest_bytes(candidate_bytes(content, size, spec.mode, spec.prefix_bytes), spec.algorithm)


def _digested(items: DataFrame, spec: ScanSpec, **digests) -> DataFrame:
    columns = ["path", "size_bytes", *(digest.alias(name) for name, digest in digests.items())]
    if "modified" in items.columns:
        columns.append("modified")
    return keep_items(items, spec).where(F.col("content").isNotNull()).select(*columns)


def _one_stage(spec: ScanSpec) -> bool:
    return spec.mode == "quick" or (spec.mode == "multi_region" and not spec.verify)


def digest_items(items: DataFrame, spec: ScanSpec = ScanSpec()) -> DataFrame:
    """``path, size_bytes, digest`` of the items that pass the filters.

    The digest is the one that decides in ``spec.mode``: the prefix in quick
    mode, the regions when ``verify`` is off, all bytes otherwise.
    """
    final = _first_digest(spec) if _one_stage(spec) else digest_bytes(F.col("content"), spec.algorithm)
    return _digested(items, spec, digest=final)


def digest_outcomes(items: DataFrame, spec: ScanSpec = ScanSpec()) -> DataFrame:
    """As :func:`digest_items`, with a row and its ``error`` for items without
    content or size: one pass over the content tells both."""
    error = F.when(F.col("content").isNull(), "no content").when(F.col("size_bytes").isNull(), "no size")
    final = _first_digest(spec) if _one_stage(spec) else digest_bytes(F.col("content"), spec.algorithm)
    columns = ["path", "size_bytes", F.when(error.isNull(), final).alias("digest"), error.alias("error")]
    columns += ["modified"] if "modified" in items.columns else []
    return keep_known_and_unknown(items, spec).select(*columns)


def _outcomes(items: DataFrame, spec: ScanSpec, staged: bool, audited: bool) -> DataFrame:
    """Rows of one pass over the items: ``outcome`` is ``kept``, ``unreadable``
    or, with ``audited``, ``rejected``; digests of kept rows only."""
    size = F.col("size_bytes")
    reason = audit_reason(items, spec)
    read = F.col("reason") == "kept"
    outcome = F.when(read, "kept").when((F.col("reason") == "unreadable") & (size.isNull() | in_size_range(size, spec)), "unreadable")
    final = _first_digest(spec) if _one_stage(spec) and not staged else digest_bytes(F.col("content"), spec.algorithm)
    error = F.when(F.col("content").isNull(), "no content").when(size.isNull(), "no size")
    columns = ["path", "size_bytes", "reason", error.alias("error"), F.when(read, final).alias("digest")]
    if staged:
        columns.append(F.when(read, _first_digest(spec)).alias("candidate_digest"))
    columns += ["modified"] if "modified" in items.columns else []
    # Filters stay below the audit where it is not asked for, so that they reach the source.
    rows = items if audited else keep_known_and_unknown(items, spec)
    return rows.withColumn("reason", reason).select(*columns, outcome.otherwise("rejected").alias("outcome"))


def digest_stages(items: DataFrame, spec: ScanSpec = ScanSpec()) -> DataFrame:
    """As above, with ``candidate_digest`` of the first stage of ``spec.mode``
    and the digest of all bytes, both from one pass over the content."""
    return _digested(
        items,
        spec,
        candidate_digest=_first_digest(spec),
        digest=digest_bytes(F.col("content"), spec.algorithm),
    )


@dataclass
class Scan:
    """Result of a scan: the digest table and what follows from it."""

    digests: Settled
    floor: int | None = None
    # Written stages of a file scan, and the files it could not read.
    stages: dict[str, Settled] = field(default_factory=dict)
    unreadable: DataFrame | None = None
    # What became of every item, if that was asked for.
    audit: DataFrame | None = None

    def drop(self) -> None:
        """Delete the written tables; frames made from them end with them."""
        lazily = [self.__dict__[name] for name in ("members", "counted") if name in self.__dict__]
        for table in (self.digests, *self.stages.values(), *lazily):
            table.drop()

    def __enter__(self) -> Scan:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    @property
    def groups(self) -> DataFrame:
        """``size_bytes, digest, n_files`` of every group of two or more."""
        return count_groups(self.digests.df)

    @cached_property
    def member_rows(self) -> DataFrame:
        """Members as a plan over the digest table, not written."""
        return shared_rows(self.digests, floor=self.floor)

    @cached_property
    def members(self) -> Settled:
        """Members as a written table, for reports that read them repeatedly."""
        if "counted" not in self.__dict__:
            return settle(self.member_rows, "members")
        groups = self.counted.df.where("n_files > 1").select(*KEYS, "n_files")
        return settle(join_groups(self.digests.df, groups, self.digests.n_rows, floor=self.floor), "members")

    @cached_property
    def counted(self) -> Settled:
        """Contents that share their first digest (that of ``candidate_digest``
        in a staged scan) with another item, with ``n_files``: written once,
        and what the funnel has to know is counted meanwhile."""
        staged = "candidate_digest" in self.digests.df.columns
        first = ["size_bytes", "candidate_digest"] if staged else KEYS
        contents = self.digests.df.groupBy(*dict.fromkeys([*first, *KEYS])).agg(F.count(F.lit(1)).alias("n_files"))
        alike = F.sum("n_files").over(W.partitionBy(*first)) if staged else F.col("n_files")
        n, size = F.col("n_files"), F.col("size_bytes")
        shared = F.when(n > 1, n)
        return settle(
            contents.withColumn("n_alike", alike).where("n_alike > 1"),
            "counted",
            figures={
                "candidate_files": F.sum(n),
                "candidate_bytes": F.sum(n * size),
                "duplicate_files": F.sum(shared),
                "duplicate_bytes": F.sum(shared * size),
                "duplicate_groups": F.count(shared),
            },
        )

    @property
    def funnel(self) -> dict[str, int]:
        """Items and bytes left after each stage, as the jobs of the scan have
        counted them; no table is read for it."""
        found = self.stages.get("found", self.digests).figures
        later = self.counted.figures
        if "candidates" in self.stages:
            alike = self.stages["candidates"].figures
            later = later | {"candidate_files": alike["n_rows"], "candidate_bytes": alike["n_bytes"]}
        return {"found_files": found["n_rows"], "found_bytes": found["n_bytes"], **later}


def scan_items(
    items: DataFrame, spec: ScanSpec = ScanSpec(), floor: int | None = None, staged: bool = False, audited: bool = False
) -> Scan:
    """Scan rows that carry their content, in one pass.

    Verified modes need no candidate stage here, as the pass that would
    compute prefixes or regions has all bytes at hand; ``staged`` computes its
    digest for the funnel all the same. Rows without content or size are
    listed in ``unreadable``; with ``audited`` all rows are in ``audit``, with
    the rule that rejected them. All of them are parts of one written table
    (its folders, if rejected rows are in it).
    """
    read = F.col("outcome") == "kept"
    figures = {"n_rows": F.count(F.when(read, 1)), "n_bytes": F.sum(F.when(read, F.col("size_bytes")))}
    written = settle(_outcomes(items, spec, staged, audited), "outcomes", compact=True, figures=figures, parts="outcome" if audited else None)
    kept = written.df.where(read).drop("outcome", "reason", "error")
    lost = written.df.where("outcome = 'unreadable'").select("path", "error")
    everything = written.df.select("path", "size_bytes", "reason") if audited else None
    return Scan(Settled(kept, written.folder, written.observed), floor, unreadable=lost, audit=everything)


def scan_groups(items: DataFrame, spec: ScanSpec = ScanSpec()) -> DataFrame:
    """Only the groups with their counts: one aggregation, nothing written."""
    return count_groups(digest_items(items, spec))


def candidates_by_size(items: DataFrame, spec: ScanSpec = ScanSpec(), floor: int | None = None) -> DataFrame:
    """Items whose size occurs more than once."""
    rows = settle(keep_items(items, spec).select("path", "size_bytes"), "sizes", compact=True)
    return shared_rows(rows, ["size_bytes"], floor).drop("n_files")


def _covered_bytes(spec: ScanSpec) -> int:
    """Sizes up to which the first stage has digested all bytes already."""
    return REGION_MIN_BYTES if spec.mode == "multi_region" else PREFIX_TIERS[0][1]


def scan_files(
    spark: SparkSession,
    bases: str | list[str],
    spec: ScanSpec = ScanSpec(),
    floor: int | None = None,
) -> Scan:
    """Scan files: size, then prefix, then all bytes.

    Every stage is written, so a file is opened at most once per stage, and a
    file whose prefix covers it is not opened again. ``unreadable`` lists what
    could not be listed, opened, or had another size when it was read.

    Folders that no executor mounts (object stores) are read as rows by
    :func:`contentdup.sources.tables.binary_file_items`; the two kinds cannot
    be mixed in one scan.
    """
    bases = [bases] if isinstance(bases, str) else list(bases)
    mounted = [mounted_path(base) is not None for base in bases]
    if not any(mounted):
        # Folders inside others are left out before listing, so no file comes twice.
        items = reduce(DataFrame.unionByName, (binary_file_items(spark, base) for base in outer_folders(bases, spec)))
        return scan_items(items, spec, floor)
    if not all(mounted):
        raise ValueError("scan mounted folders and object stores separately")
    entries = settle(inventory(spark, bases, spec), "entries").df
    unlisted = entries.where(F.col("error").isNotNull()).select("path", "error")
    found = keep_items(entries.where(F.col("error").isNull()), spec)
    sized = settle(found.select("path", "size_bytes", "modified"), "inventory", figures=rows_and_bytes())
    same_size = settle(shared_rows(sized, ["size_bytes"], floor).drop("n_files"), "same-size", figures=rows_and_bytes())
    first = settle(read_digests(same_size.df, spec.mode, spec.prefix_bytes, spec.algorithm), "prefix-digests")
    stages = {"found": sized, "same_size": same_size}
    readable, failed = _by_outcome(first)
    failed = unlisted.unionByName(failed)
    if _one_stage(spec):
        return Scan(readable, floor, stages, failed)
    alike = settle(shared_rows(readable, KEYS, floor).drop("n_files"), "alike", figures=rows_and_bytes())
    covered = F.col("size_bytes") <= _covered_bytes(spec)
    whole = settle(read_digests(alike.df.where(~covered), "whole", algorithm=spec.algorithm), "whole-digests")
    verified, failed_later = _by_outcome(whole)
    digests = settle(alike.df.where(covered).unionByName(verified.df), "digests")
    return Scan(digests, floor, stages | {"candidates": alike}, failed.unionByName(failed_later))


def _by_outcome(read: Settled) -> tuple[Settled, DataFrame]:
    """Rows with a digest, and path and error of the others."""
    return (
        Settled(read.df.where("digest IS NOT NULL").drop("error"), read.folder),
        read.df.where("digest IS NULL").select("path", "error"),
    )


def stage_counts(scan: Scan) -> DataFrame:
    """Files and bytes that each stage of a file scan left, duplicates last."""
    stages = {name: stage.df for name, stage in scan.stages.items()} | {"duplicates": scan.members.df}
    counts = [
        rows.agg(
            F.lit(name).alias("stage"),
            F.count(F.lit(1)).alias("n_files"),
            F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
        )
        for name, rows in stages.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def quick_false_positives(
    items: DataFrame, spec: ScanSpec = ScanSpec(mode="quick"), floor: int | None = None
) -> DataFrame:
    """Members of a quick scan that a full scan of the same items clears."""
    both = settle(digest_stages(items, spec.with_(mode="quick")), "digests", compact=True)
    quick = shared_rows(both, ["size_bytes", "candidate_digest"], floor)
    full = shared_rows(both, KEYS, floor)
    return quick.join(full.select("path"), "path", "left_anti").select(
        "path", "size_bytes", "candidate_digest", "digest"
    )
