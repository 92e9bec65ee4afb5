"""Row predicates of a scan and the audit of what they reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentdup.spec import ScanSpec


def is_hidden(name: Column, dirs: Column) -> Column:
    """The item or any directory above it, below the base, starts with a dot."""
    return name.startswith(".") | F.exists(dirs, lambda d: d.startswith("."))


def in_excluded_dir(dirs: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(dirs, F.array(*map(F.lit, names))) if names else F.lit(False)


def matches_glob(name: Column, patterns: tuple[str, ...]) -> Column:
    """Case-sensitive shell patterns against the base name."""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | name.rlike(glob_regex(pattern))
    return hit


def _quoted(character: str) -> str:
    return character if character.isascii() and character.isalnum() else f"\\x{{{ord(character):X}}}"


def _class_regex(inside: str) -> str:
    """A bracket expression without its brackets, as a Java class."""
    negated = inside.startswith("!")
    inside = inside[negated:]
    items, at = [], 0
    while at < len(inside):
        if at + 2 < len(inside) and inside[at + 1] == "-":
            low, high = inside[at], inside[at + 2]
            if low <= high:
                items.append(f"{_quoted(low)}-{_quoted(high)}")
            at += 3
        else:
            items.append(_quoted(inside[at]))
            at += 1
    if not items:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(items)}]"


def glob_regex(pattern: str) -> str:
    """A shell pattern as a Java regular expression for the whole name.

    ``*`` and ``?`` match any characters, line ends included; brackets hold
    characters and ranges, ``!`` first negates. A ``]`` counts as a character
    when it comes first; a bracket that is never closed is a plain ``[``.
    """
    parts, at = [], 0
    while at < len(pattern):
        character = pattern[at]
        at += 1
        if character == "*":
            parts.append(".*")
        elif character == "?":
            parts.append(".")
        elif character == "[":
            first = at + (pattern[at : at + 1] == "!")
            close = pattern.find("]", first + (pattern[first : first + 1] == "]"))
            if close < 0:
                parts.append(_quoted("["))
            else:
                parts.append(_class_regex(pattern[at:close]))
                at = close + 1
        else:
            parts.append(_quoted(character))
    return "(?s)\\A" + "".join(parts) + "\\z"


def in_size_range(size: Column, spec: ScanSpec) -> Column:
    kept = size.isNotNull()
    if spec.min_bytes is not None:
        kept = kept & (size >= spec.min_bytes if spec.inclusive else size > spec.min_bytes)
    if spec.max_bytes is not None:
        kept = kept & (size <= spec.max_bytes if spec.inclusive else size < spec.max_bytes)
    return kept


def _entry_rules(spec: ScanSpec) -> list[tuple[str, Column]]:
    """Rejections by kind, name and place, in the order they are tested."""
    name, dirs = F.col("name"), F.col("dirs")
    rules = [("symlink", F.col("is_symlink"))]
    if spec.exclude_hidden:
        rules.append(("hidden", is_hidden(name, dirs)))
    if spec.exclude_dirs:
        rules.append(("excluded_dir", in_excluded_dir(dirs, spec.exclude_dirs)))
    if spec.exclude:
        rules.append(("excluded_file", matches_glob(name, spec.exclude)))
    return rules


def _pass_entry_rules(items: DataFrame, spec: ScanSpec) -> DataFrame:
    for _, rejected in _entry_rules(spec):
        items = items.where(~rejected)
    return items


def keep_items(items: DataFrame, spec: ScanSpec) -> DataFrame:
    """Items that pass every rule of ``spec``; one ``where`` per rule."""
    return _pass_entry_rules(items, spec).where(in_size_range(F.col("size_bytes"), spec))


def keep_known_and_unknown(items: DataFrame, spec: ScanSpec) -> DataFrame:
    """As :func:`keep_items`, and items whose size is not known: it may be in
    any range."""
    size = F.col("size_bytes")
    return _pass_entry_rules(items, spec).where(size.isNull() | in_size_range(size, spec))


def audit_reason(items: DataFrame, spec: ScanSpec) -> Column:
    """The first rule that rejects an item, or ``kept``."""
    size = F.col("size_bytes")
    lost = size.isNull() | F.col("content").isNull() if "content" in items.columns else size.isNull()
    rules = [*_entry_rules(spec), ("unreadable", lost), ("size_out_of_range", ~in_size_range(size, spec))]
    reason = F
    for label, rejected in rules:
        reason = reason.when(rejected, F.lit(label))
    return reason.otherwise(F.lit("kept"))


def audit(items: DataFrame, spec: ScanSpec) -> DataFrame:
    """Every item with the first rule that rejects it, or ``kept``."""
    return items.select("path", "size_bytes", audit_reason(items, spec).alias("reason"))


def audit_counts(audited: DataFrame) -> DataFrame:
    return audited.groupBy("reason").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
    )


def path_contains(rows: DataFrame, keyword: str) -> DataFrame:
    """Case-insensitive substring filter over result rows; empty keeps all."""
    return rows.where(F.contains(F.lower("path"), F.lit(keyword.lower()))) if keyword else rows
