"""Reports over the members of a scan, and the scan-to-export run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentdup.functions.display import display_digest, format_bytes, short_digest
from contentdup.functions.paths import relative_path
from contentdup.operators.groups import KEYS
from contentdup.operators.numbering import number_members
from contentdup.operators.removal import removal_by_decision, removal_manifest
from contentdup.operators.settle import settle
from contentdup.operators.summary import scan_summary
from contentdup.plans.export import write_csv, write_json
from contentdup.plans.scan import Scan

# Paths per row of the nested form; larger groups continue in further rows.
PATHS_PER_ROW = 10_000


def _numbered(members: DataFrame) -> DataFrame:
    return members if "member_no" in members.columns else number_members(members)


def detail_report(members: DataFrame, base: str | None = None) -> DataFrame:
    """Group number, size text, short digest, member number and path.

    The reports take members, or members that are numbered already.
    """
    path = F.col("path") if base is None else relative_path(F.col("path"), base)
    return _numbered(members).select(
        "group_no",
        format_bytes(F.col("size_bytes")).alias("size_text"),
        short_digest(F.col("digest")).alias("short_digest"),
        "member_no",
        path.alias("path"),
    )


def result_table(members: DataFrame) -> DataFrame:
    """Display values next to the raw values they are sorted by."""
    return _numbered(members).select(
        "group_no",
        "size_bytes",
        format_bytes(F.col("size_bytes")).alias("size_text"),
        "digest",
        display_digest(F.col("digest")).alias("display_digest"),
        "path",
    )


# The number behind each displayed column.
SORT_VALUES = {"group": "group_no", "size": "size_bytes", "hash": "digest", "path": "path"}


def sort_rows(rows: DataFrame, column: str = "group", ascending: bool = True) -> DataFrame:
    """Order a result table by a displayed column, numeric where it is a number."""
    first = F.col(SORT_VALUES[column])
    # Further columns make the order definite and spread equal values over tasks.
    return rows.orderBy(first.asc() if ascending else first.desc(), *KEYS, "path")


def sort_groups(groups: DataFrame) -> DataFrame:
    return groups.orderBy(*KEYS)


def nested_groups(members: DataFrame, paths_per_row: int = PATHS_PER_ROW) -> DataFrame:
    """``size_bytes, hash, part, n_files, paths``: one row per group, the paths
    in order; a group with more than ``paths_per_row`` paths continues in rows
    with ``part`` 1, 2, ..."""
    return (
        _numbered(members)
        .groupBy(
            "size_bytes",
            F.col("digest").alias("hash"),
            F.floor(F.col("member_no") / paths_per_row).alias("part"),
            "n_files",
        )
        .agg(F.sort_array(F.collect_list("path")).alias("paths"))
    )


@dataclass
class Report:
    summary: DataFrame
    details: DataFrame
    manifest: DataFrame


def report(
    scan: Scan,
    json_out: str | None = None,
    csv_out: str | None = None,
    keep: str = "first_path",
    decisions: DataFrame | None = None,
    paths_per_row: int = PATHS_PER_ROW,
) -> Report:
    """Summary, details, removal manifest (dry run) and exports of one scan;
    all of them read the written members.

    With ``decisions`` (a choice per group, see
    :func:`contentdup.operators.removal.read_decisions`) the manifest follows
    them, else ``keep``. The exports show the scan before any removal.
    """
    members = scan.members
    numbered = settle(number_members(members.df), "numbered").df
    if json_out:
        write_json(nested_groups(numbered, paths_per_row), json_out)
    if csv_out:
        write_csv(members.df, csv_out)
    return Report(
        summary=scan_summary(scan.groups),
        details=detail_report(numbered),
        manifest=removal_manifest(members, keep) if decisions is None else removal_by_decision(members, decisions),
    )
