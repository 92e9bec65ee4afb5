"""Group numbers and member numbers without a window over a whole group.

Members are range-partitioned and sorted by size, digest and path, so that a
large group spreads over several pieces. Each piece numbers its own rows while
it is written, in order. What a piece takes over from those before it (groups
begun, and members of a group that goes on) comes from a table with one row per
piece. So members are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentdup.operators.groups import KEYS
from contentdup.operators.settle import settle
from contentdup.ship import ship

_PLACE = ["_piece", "_group", "_row"]


def _begins(batch: pa.RecordBatch, last: tuple | None) -> np.ndarray:
    """Whether each row has another key than the one before it."""
    changed = np.zeros(batch.num_rows, bool)
    for place, name in enumerate(KEYS):
        column = batch.column(name)
        differs = pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1))
        changed[1:] |= differs.fill_null(True).to_numpy(zero_copy_only=False).astype(bool)
        changed[0] |= last is None or column[0].as_py() != last[place]
    return changed


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the piece, the number of the group in it and of the row in that."""
    piece, last, group, row = TaskContext.get().partitionId(), None, 0, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        begins = _begins(batch, last)
        groups = group + np.cumsum(begins)
        at = np.arange(batch.num_rows)
        # The first row of each row's group; before this batch for the first one.
        start = np.maximum.accumulate(np.where(begins, at, -row - 1))
        rows = at - start
        last, group, row = tuple(batch.column(c)[-1].as_py() for c in KEYS), int(groups[-1]), int(rows[-1])
        added = [np.full(batch.num_rows, piece, np.int32), groups, rows]
        names = [*batch.schema.names, *_PLACE]
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, added)], names)


def _taken_over(placed: DataFrame) -> DataFrame:
    """Per piece: groups begun before its first group, members of that group
    that lie in earlier pieces. The windows here see one row per piece."""
    key, at = F.struct(*KEYS), F.struct("_group", "_row")
    ends = placed.groupBy("_piece").agg(
        F.max("_group").alias("n_groups"),
        F.min(key).alias("first"),
        F.max(key).alias("last"),
        (F.max(at)["_row"] + 1).alias("last_rows"),
    )
    in_order = W.orderBy("_piece")
    goes_on = F.coalesce((F.col("first") == F.lag("last").over(in_order)).cast("bigint"), F.lit(0))
    return (
        ends.withColumn("so_far", F.sum("last_rows").over(W.partitionBy("last").orderBy("_piece")))
        .withColumn("goes_on", goes_on)
        .select(
            "_piece",
            (F.sum(F.col("n_groups") - F.col("goes_on")).over(in_order) - F.col("n_groups")).alias("groups_before"),
            (F.col("goes_on") * F.coalesce(F.lag("so_far").over(in_order), F.lit(0))).alias("members_before"),
        )
    )


def number_members(members: DataFrame, pieces: int | None = None) -> DataFrame:
    """Add ``group_no`` (from 1, by size and digest) and ``member_no`` (from 0,
    by path); other columns stay."""
    ship(members.sparkSession)
    order = [*KEYS, "path"]
    ranged = members.repartitionByRange(pieces, *order) if pieces else members.repartitionByRange(*order)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema)
    numbered = ranged.sortWithinPartitions(*order).mapInArrow(_number, f"{columns}, _piece int, _group bigint, _row bigint")
    placed = settle(numbered, "placed").df
    before = F.when(F.col("_group") == 1, F.col("members_before")).otherwise(F.lit(0))
    return placed.join(F.broadcast(_taken_over(placed)), "_piece").select(
        *members.columns,
        (F.col("groups_before") + F.col("_group")).alias("group_no"),
        (F.col("_row") + before).alias("member_no"),
    )
