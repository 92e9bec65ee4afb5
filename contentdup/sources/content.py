"""Digests of files by path, read inside tasks in chunks of fixed size."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentdup.functions.digests import LARGEST_PREFIX, PREFIX_TIERS, WHOLE_UP_TO, prefix_length
from contentdup.operators.settle import settle
from contentdup.ship import ship
from contentdup.spec import REGION_BYTES, REGION_MIN_BYTES

_CHUNK = 1024 * 1024
_BYTES_PER_TASK = 512 * 1024 * 1024
_FILES_PER_TASK = 20_000


def _ranges(size: int, how: str, prefix: int) -> list[tuple[int, int]]:
    """(offset, length) of the bytes to digest; length -1 reads to the end."""
    if how == "whole":
        return [(0, -1)]
    if how == "quick":
        return [(0, prefix)]
    if how == "multi_region" and size > REGION_MIN_BYTES:
        starts = (0, size // 2 - REGION_BYTES // 2, size - REGION_BYTES)
        return [(start, REGION_BYTES) for start in starts]
    if size <= WHOLE_UP_TO:
        return [(0, -1)]
    return [(0, next((length for bound, length in PREFIX_TIERS if size <= bound), LARGEST_PREFIX))]


def _digest_file(path: str, how: str, prefix: int, algorithm: str) -> tuple[str, int]:
    """The digest and the size that the file has while it is read."""
    state = hashlib.blake2b() if algorithm == "blake2b" else hashlib.sha256()
    if not stat.S_ISREG(os.stat(path).st_mode):
        raise OSError(f"not a regular file: {path}")
    with open(path, "rb") as file:
        size = os.fstat(file.fileno()).st_size
        for offset, left in _ranges(size, how, prefix):
            file.seek(offset)
            while chunk := file.read(_CHUNK if left < 0 else min(left, _CHUNK)):
                state.update(chunk)
                left -= len(chunk) if left > 0 else 0
                if left == 0:
                    break
        if os.fstat(file.fileno()).st_size != size:
            raise OSError(f"size changed while reading: {path}")
    return state.hexdigest(), size


def _cost(size: Column, how: str, prefix: int) -> Column:
    """Bytes that will be read from a file of this size."""
    if how == "whole":
        return size
    if how == "quick":
        return F.least(size, F.lit(prefix))
    tier = F.when(prefix_length(size) == -1, size).otherwise(prefix_length(size))
    return F.when(size > REGION_MIN_BYTES, F.lit(3 * REGION_BYTES)).otherwise(tier) if how == "multi_region" else tier


def read_digests(
    files: DataFrame, how: str = "whole", prefix: int = 4096, algorithm: str = "sha2", column: str = "digest"
) -> DataFrame:
    """Add the digest (null with ``error`` set when a file cannot be read, or
    has another size than the row says).

    ``files`` should be a written table: it is read twice, once to size the
    tasks. Files are dealt out in order of size, so that tasks get about
    equal bytes, and each reads its largest first. The number of tasks is
    explicit since the rows are far smaller than the files.
    """
    ship(files.sparkSession)
    load = files.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(_cost(F.col("size_bytes"), how, prefix)), F.lit(0)).alias("total"),
    ).first()
    tasks = max(
        min(files.sparkSession.sparkContext.defaultParallelism, load.n),
        -(-load.total // _BYTES_PER_TASK),
        -(-load.n // _FILES_PER_TASK),
        1,
    )

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests, errors = [], []
            for path, expected in zip(batch["path"], batch["size_bytes"]):
                try:
                    found, size = _digest_file(path, how, prefix, algorithm)
                    if size != expected:
                        raise OSError(f"size changed since the inventory: {path}")
                    digests.append(found)
                    errors.append(None)
                except OSError as problem:
                    digests.append(None)
                    errors.append(str(problem))
            yield batch.assign(**{column: digests, "error": errors})

    rows = files.drop("error", column)
    # Times go through Python as numbers, as its calendar ends before Spark's.
    times = [f.name for f in rows.schema if f.dataType.simpleString() == "timestamp"]
    rows = rows.withColumns({name: F.unix_micros(name) for name in times})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    by_size = rows.repartitionByRange(F.desc("size_bytes"), "path").sortWithinPartitions(F.desc("size_bytes"), "path")
    # The low bits count the rows of a piece: files of similar size go round.
    turn = F.pmod(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)), F.lit(tasks))
    dealt = settle(by_size.withColumn("turn", turn.cast("int")), "dealt").df
    return (
        dealt.repartitionById(tasks, "turn")
        .drop("turn")
        .sortWithinPartitions(F.desc("size_bytes"))
        .mapInPandas(digest, f"{schema}, {column} string, error string")
        .withColumns({name: F.timestamp_micros(name) for name in times})
    )
