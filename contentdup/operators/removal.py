"""Removal as data: manifests first, execution only on request."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentdup.operators.among import without
from contentdup.operators.groups import KEYS, count_groups, join_groups, keepers
from contentdup.operators.numbering import number_members
from contentdup.operators.settle import Settled, settle
from contentdup.ship import ship


# Fixed value: how an integer may be written in a choice.
INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"


def _carried(members: DataFrame) -> list[str]:
    """Columns that a manifest takes along to recognise the file later."""
    return [c for c in ("modified",) if c in members.columns]


def _action(rows: DataFrame, dry_run: bool) -> DataFrame:
    return rows.withColumn("action", F.lit("would_delete" if dry_run else "delete"))


def removal_manifest(members: Settled, policy: str = "first_path", dry_run: bool = True) -> DataFrame:
    """All members of each group but the one that stays."""
    rows = join_groups(members.df.drop("n_files"), keepers(members.df, policy), members.n_rows)
    return _action(
        rows.where(F.col("path") != F.col("keep_path")).select(*KEYS, "path", "keep_path", *_carried(rows)), dry_run
    )


def survivors(items: DataFrame, manifest: DataFrame) -> DataFrame:
    """Items whose path the manifest does not name.

    Items may carry content and the manifest may be large: rows that a bit
    table of the paths to remove rules out stay where they are, the others are
    matched exactly.
    """
    named = settle(manifest.select("path").distinct(), "removed-paths")
    return without(items, named.df, named.n_rows)


def read_decisions(decisions: DataFrame) -> DataFrame:
    """Parse ``choice``: ``a`` (all but the first), ``s`` (skip) or 0-based
    member numbers separated by commas. One bad number voids the choice, and
    so do two different choices for one group."""
    blank = r"^\s+|\s+$"
    tidy = decisions.select(*KEYS, F.lower(F.regexp_replace(F.coalesce("choice", F.lit("")), blank, "")).alias("choice"))
    single = tidy.groupBy(*KEYS).agg(F.min("choice").alias("choice"), F.max("choice").alias("other"))
    choice = F.when(F.col("choice") == F.col("other"), F.col("choice")).otherwise(F.concat_ws(" / ", "choice", "other"))
    tokens = F.transform(F.split("choice", ","), lambda t: F.regexp_replace(t, blank, ""))
    numbers = F.transform(tokens, lambda t: F.replace(t, F.lit("_"), F.lit("")).try_cast("bigint"))
    word = F.col("choice").isin("a", "s")
    return single.select(*KEYS, choice.alias("choice")).select(
        "*",
        F.when(~word, numbers).alias("numbers"),
        (word | F.forall(tokens, lambda t: t.rlike(INTEGER))).alias("valid"),
    )


def _with_keep_path(chosen: DataFrame, staying: DataFrame) -> DataFrame:
    """Add ``keep_path``, the first member of the group that stays; null only
    where none does."""
    first = staying.groupBy(*KEYS).agg(F.min("path").alias("keep_path"))
    return chosen.join(first, KEYS, "left")


def removal_by_decision(members: Settled, decisions: DataFrame, dry_run: bool = True) -> DataFrame:
    """Members that the decision on their group names; numbers outside the
    group are ignored, a group may lose all members."""
    parsed = settle(read_decisions(decisions).where("valid AND choice <> 's'"), "decisions").df
    decided = parsed.select(*KEYS, "choice").join(count_groups(members.df), KEYS)
    extra = _carried(members.df)
    numbered = number_members(join_groups(members.df.select(*KEYS, "path", *extra), decided, members.n_rows))
    named = (
        parsed.select(*KEYS, F.explode("numbers").alias("member_no")).distinct().withColumn("named", F.lit(True))
    )
    goes = F.coalesce("named", F.lit(False)) | ((F.col("choice") == "a") & (F.col("member_no") > 0))
    marked = settle(numbered.join(named, [*KEYS, "member_no"], "left").withColumn("goes", goes), "decided-members").df
    chosen = _with_keep_path(marked.where("goes"), marked.where("NOT goes"))
    return _action(chosen.select(*KEYS, "path", "member_no", "keep_path", *extra), dry_run)


def invalid_decisions(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions on existing groups that could not be read; those groups stay."""
    return groups.select(*KEYS).join(read_decisions(decisions).where("NOT valid"), KEYS).select(*KEYS, "choice")


def removal_selected(
    members: DataFrame, selected: DataFrame, keep_one: bool = True, dry_run: bool = True
) -> DataFrame:
    """Members whose paths were picked one by one.

    ``keep_one`` leaves the first path of a group whose members were all
    picked; switch it off to remove exactly what was picked.
    """
    picks = selected.select("path").distinct().withColumn("picked", F.lit(True))
    columns = [*KEYS, "path", *_carried(members)]
    marked = settle(members.select(*columns).join(picks, "path", "left"), "marked").df
    picked, others = marked.where("picked").select(*columns), marked.where("picked IS NULL")
    if keep_one:
        # One row per group on both sides of the joins below.
        first = picked.groupBy(*KEYS).agg(F.min("path").alias("path"))
        spared = settle(first.join(others.select(*KEYS).distinct(), KEYS, "left_anti"), "spared").df
        picked = picked.join(spared.select("path"), "path", "left_anti")
        others = others.select(*KEYS, "path").unionByName(spared.select(*KEYS, "path"))
    return _action(_with_keep_path(picked, others).select(*KEYS, "path", "keep_path", *_carried(members)), dry_run)


_LOG_SCHEMA = "path string, status string, error string"


def _refusal(path: str, size: int, keep: str | None, modified: float | None) -> str | None:
    """Why a file must stay, or None."""
    found = os.lstat(path)
    if found.st_size != size:
        return "size changed since the scan"
    if modified is not None and abs(found.st_mtime - modified) > 1e-5:
        return "changed since the scan"
    if keep is None:
        return None
    try:
        kept = os.lstat(keep)
    except FileNotFoundError:
        return f"kept copy is missing: {keep}"
    same_entry = os.path.realpath(path) == os.path.realpath(keep)
    if same_entry or (os.path.samestat(found, kept) and found.st_nlink == 1):
        return f"kept copy is this file: {keep}"
    if kept.st_size != size:
        return f"kept copy has changed: {keep}"
    return None


def _delete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, size, keep, modified in zip(*(batch[c] for c in ("path", "size_bytes", "keep_path", "modified"))):
            status, error = "deleted", None
            try:
                error = _refusal(path, size, keep, None if pd.isna(modified) else modified)
                if error is None:
                    os.remove(path)
                else:
                    status = "failed"
            except FileNotFoundError:
                status = "absent"
            except OSError as problem:
                status, error = "failed", str(problem)
            rows.append((path, status, error))
        yield pd.DataFrame(rows, columns=["path", "status", "error"])


def execute_removal(manifest: DataFrame, dry_run: bool = True) -> DataFrame:
    """Carry out a manifest on mounted storage and return the log.

    A file stays when its size or (where the manifest has ``modified``) its
    time of change is another one, when the copy to keep is missing, has
    another size, or is the same file under another name. A file that is
    already gone counts as ``absent``, so a repeated task does no harm;
    failures are logged and the rest goes on. The log is written before it is
    returned: reading it again deletes nothing.
    """
    if dry_run:
        return manifest.select("path", F.lit("would_delete").alias("status"), F.lit(None).cast("string").alias("error"))
    ship(manifest.sparkSession)
    keep = F.col("keep_path") if "keep_path" in manifest.columns else F.lit(None).cast("string")
    modified = F.unix_micros("modified") / 1e6 if "modified" in manifest.columns else F.lit(None).cast("double")
    todo = manifest.select("path", "size_bytes", keep.alias("keep_path"), modified.alias("modified"))
    return settle(todo.mapInPandas(_delete, _LOG_SCHEMA), "removal-log").df
