"""Column expressions over slash-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_names(path: Column) -> Column:
    """Names of the directories above the item, outermost first."""
    return F.filter(
        F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1),
        lambda part: part != "",
    )


def dir_path(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def relative_path(path: Column, base: str) -> Column:
    """Path below ``base``; other paths stay as they are."""
    prefix = base.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 2**31 - 1)).otherwise(path)
