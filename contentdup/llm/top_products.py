"""Exact search for the largest inner products, by norm buckets.

Vectors are ordered by length and cut into buckets. The bucket of the longest
ones gives every query a first list of results, whose last score is its
threshold; the next ones follow in phases, each of eight times as many buckets,
and every phase raises the thresholds for the one after. A bucket whose longest
vector cannot reach a query's threshold is never sent to it. In the others the
threshold, divided by the lengths of query and bucket, is a local cosine
threshold: where it is high, ranges of single coordinates leave few candidates,
else the length alone cuts the bucket short. What is left is verified by its
product. All results are exact.

Who needs which bucket is settled on rows without vectors: lengths fall into
classes of a quarter of an octave, a query is joined with the classes it may
reach and then held against the very length. Queries that reach alike share a
slot. Bucket and slot meet in blocks of bounded size, so neither is held whole,
and a bucket goes to no slot that has no query for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentdup.operators.settle import settle
from contentdup.ship import ship

BUCKET_ROWS = 4096
QUERY_ROWS = 4096
# Local cosine thresholds from which coordinates are worth looking at.
COORDINATE_FROM = 0.4
FOCUS = 4
_EXACT = 2.0**52
# Buckets of a phase, times those of the one before.
PHASE_GROWTH = 8
# Classes of length in an octave, and parts of a class when it is joined.
OCTAVE_CLASSES = 4
CLASS_PARTS = 32
# Parts of a bucket when it is joined with the slots that need it.
BUCKET_PARTS = 8
_MARGIN = 1 + 1e-9

_FOUND = "query_id bigint, vec_id bigint, score bigint"


def _matrix(column: pa.Array, scale: int) -> np.ndarray:
    """Rows as whole numbers; shorter vectors are filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * float(scale))
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _widen(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def _products(rows: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products; whole numbers beyond double precision are multiplied as
    such, and scores outside 64 bits take the nearest 64-bit number."""
    if exact:
        return (rows @ query).astype(np.int64)
    wide = [int(x) for x in query]
    sums = [sum(int(a) * b for a, b in zip(row, wide)) for row in rows]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in sums], np.int64)


class Bucket:
    """Vectors of similar length, the longest first."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        norms = np.sqrt((matrix * matrix).sum(axis=1))
        order = np.lexsort((ids, -norms))
        self.ids, self.matrix, self.norms = ids[order], matrix[order], norms[order]
        with np.errstate(divide="ignore", invalid="ignore"):
            # Directions by coordinate; a zero vector has none.
            self.directions = np.nan_to_num(self.matrix / self.norms[:, None]).T.copy()

    def candidates(self, query: np.ndarray, length: float, threshold: float | None) -> np.ndarray | slice:
        """Rows that may reach ``threshold``; a small margin covers rounding."""
        if threshold is None or threshold <= 0 or not length:
            return slice(None)
        needed = threshold / length * (1 - 1e-9)
        stop = int(np.searchsorted(-self.norms, -needed, side="right"))
        local = needed / self.norms[0] if self.norms[0] else 2.0
        if local < COORDINATE_FROM or stop < 32:
            return slice(0, stop)
        direction = query / length
        focus = np.argpartition(-np.abs(direction), min(FOCUS, len(direction)) - 1)[:FOCUS]
        keep = np.ones(stop, bool)
        local = min(local, 1.0)
        for place in focus:
            middle = direction[place] * local
            spread = math.sqrt(max(0.0, (1 - local * local) * (1 - direction[place] ** 2))) + 1e-9
            low = -1.0 if direction[place] <= -local else middle - spread
            high = 1.0 if direction[place] >= local else middle + spread
            column = self.directions[place, :stop]
            keep &= (column >= low) & (column <= high)
        return np.flatnonzero(keep)

    def best(self, query_id: int, query: np.ndarray, threshold: float | None, k: int, exact: bool):
        length = math.sqrt(float(query @ query))
        rows = self.candidates(query, length, threshold)
        ids = self.ids[rows]
        scores = _products(self.matrix[rows], query, exact)
        keep = ids != query_id
        if threshold is not None:
            keep &= scores >= threshold
        ids, scores = ids[keep], scores[keep]
        if len(ids) > k:
            floor = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = scores >= floor
            ids, scores = ids[near], scores[near]
        top = np.lexsort((ids, -scores))[:k]
        return ids[top], scores[top]


def _search(k: int, scale: int):
    """For partitions sorted by block, the bucket's rows before the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, bucket = None, [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            sides = batch.column("is_query").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(sides.astype(np.int8)) != 0)) + 1), len(blocks)]
            for start, stop in zip(cuts[:-1], cuts[1:]):
                if start == stop:
                    continue
                piece = batch.slice(start, stop - start)
                if blocks[start] != key:
                    key, parts, bucket = blocks[start], [], None
                ids = piece.column("vec_id").to_numpy()
                matrix = _matrix(piece.column("embedding"), scale)
                if not sides[start]:
                    parts.append((ids, matrix))
                    bucket = None
                    continue
                if not parts:
                    continue
                if bucket is None:
                    width = max(m.shape[1] for _, m in parts)
                    bucket = Bucket(np.concatenate([i for i, _ in parts]), np.concatenate([_widen(m, width) for _, m in parts]))
                width = max(matrix.shape[1], bucket.matrix.shape[1])
                if bucket.matrix.shape[1] < width:
                    bucket = Bucket(bucket.ids, _widen(bucket.matrix, width))
                matrix = _widen(matrix, width)
                largest = np.sqrt((matrix * matrix).sum(axis=1)).max() * bucket.norms[0]
                found = []
                for query_id, query, threshold in zip(ids, matrix, piece.column("threshold").to_pylist()):
                    best, scores = bucket.best(query_id, query, threshold, k, bool(largest < _EXACT))
                    found.append((np.full(len(best), query_id), best, scores))
                columns = [np.concatenate(c) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return run


def _parts(count: int) -> F.Column:
    return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))


def _cut(rows: DataFrame, order: list, size: int, label: str, number: str) -> DataFrame:
    """Rows in ranges of ``order``, with the ``number`` of the run of ``size``
    rows each is in, whatever the pieces they are sorted in."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settle(ordered.withColumn("row_slot", F.monotonically_increasing_id()), label).df
    placed = placed.withColumn("piece", F.shiftright("row_slot", 33))
    counts = placed.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))  # one row per piece
    place = F.col("start") + F.col("row_slot") - F.shiftleft("piece", 33)
    return placed.join(F.broadcast(starts), "piece").withColumn(number, F.floor(place / F.lit(size))).drop("row_slot", "piece", "start")


def _class(length: F.Column) -> F.Column:
    return F.floor(F.lit(OCTAVE_CLASSES) * F.log2(F.least(length, F.lit(1e308))))


def _searches(asked: DataFrame, lengths: DataFrame) -> DataFrame:
    """``vec_id, slot, threshold, bucket``: the buckets whose ``longest`` vector
    may give a query its threshold, i.e. is at least its ``reach``. Narrow rows;
    a class that holds most buckets is joined in parts."""
    lengths = lengths.where("longest > 0").withColumn("class", _class(F.col("longest")))
    ends = lengths.agg(F.min("class").alias("least"), F.max("class").alias("most")).first()
    if ends.least is None:
        return asked.select("vec_id", "slot", "threshold", F.lit(0).cast("bigint").alias("bucket")).where("false")
    least, most = F.lit(ends.least), F.lit(ends.most)
    # One class below for rounding; the very length decides.
    lowest = F.when(F.col("reach") > 0, F.greatest(_class(F.col("reach")) - 1, least)).otherwise(least)
    wanted = asked.withColumn("lowest", lowest).where(F.col("lowest") <= most)
    wanted = wanted.withColumn("class", F.explode(F.sequence("lowest", most)))
    wanted = wanted.withColumn("class_part", F.pmod(F.xxhash64("vec_id"), F.lit(CLASS_PARTS)).cast("int"))
    there = lengths.withColumn("class_part", _parts(CLASS_PARTS))
    return (
        wanted.join(there, ["class", "class_part"])
        .where(F.col("longest") * F.lit(_MARGIN) >= F.col("reach"))
        .select("vec_id", "slot", "threshold", "bucket")
    )


def _blocks_of(vectors: DataFrame, queries: DataFrame, searches: DataFrame, slots: int) -> DataFrame:
    """Rows of all blocks: a bucket in every slot that has a query for it, a
    query in the block of each of its buckets."""
    block = (F.col("bucket") * F.lit(slots) + F.col("slot")).cast("bigint").alias("block")
    needed = searches.select("bucket", "slot").distinct().withColumn("bucket_part", _parts(BUCKET_PARTS))
    parted = vectors.withColumn("bucket_part", F.pmod(F.xxhash64("vec_id"), F.lit(BUCKET_PARTS)).cast("int"))
    here = parted.join(needed, ["bucket", "bucket_part"]).select(
        block, F.lit(False).alias("is_query"), "vec_id", "embedding", F.lit(None).cast("double").alias("threshold")
    )
    asked = searches.join(queries, "vec_id").select(block, F.lit(True).alias("is_query"), "vec_id", "embedding", "threshold")
    return here.unionByName(asked)


def _meet(blocks: DataFrame, k: int, scale: int) -> DataFrame:
    """The best ``k`` of each query in each of its blocks."""
    return blocks.repartition("block").sortWithinPartitions("block", "is_query").mapInArrow(_search(k, scale), _FOUND)


def _phases(n_buckets: int) -> list[tuple[int, int]]:
    """First bucket and the one after the last of each phase."""
    ends = [0, 1]
    while ends[-1] < n_buckets:
        ends.append(ends[-1] * PHASE_GROWTH)
    return list(zip(ends[:-1], ends[1:]))


def top_products(
    vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """The ``k`` largest inner products of each query with all other rows.

    Components become ``floor(scale * x)``. Queries are the rows whose
    ``vec_id`` is divisible by ``every``; ties go to the smaller ``vec_id``.
    Returns ``query_id, rank, vec_id, score``.

    Rows without ``vec_id``, and vectors that are null or hold null or
    non-finite components, take no part. Vectors of other lengths are filled
    up with zeros; an empty one has score 0 with all. Repeated rows are each a
    candidate; a repeated query is asked once, with its largest vector. A
    query without candidates, or an empty table, gives no rows. Further
    columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    # Never below the length of the whole numbers: floor moves x by less than 1.
    bound = F.sqrt(
        F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (F.abs(x * F.lit(float(scale))) + 1) * (F.abs(x * F.lit(float(scale))) + 1))
    )
    usable = (
        vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where(finite)
        .withColumn("norm", bound)
    )
    rows = _cut(usable, [F.desc("norm"), F.col("vec_id")], bucket_rows, "vectors", "bucket")
    queries = (
        rows.where(F.col("vec_id") % every == 0)
        .groupBy("vec_id")
        .agg(F.max(F.struct("embedding", "norm")).alias("q"))
        .select("vec_id", "q.embedding", "q.norm")
    )
    queries = settle(queries, "queries").df
    # The vector of an empty list has length 0; 1 is above it and below all others.
    longest = F.greatest(F.max("norm"), F.lit(1.0)).alias("longest")
    lengths = settle(rows.groupBy("bucket").agg(longest), "lengths").df

    best = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    last = F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double")
    for start, stop in _phases(lengths.count()):
        thresholds = best.groupBy(F.col("query_id").alias("vec_id")).agg(last.alias("threshold"))
        asked = queries.select("vec_id", "norm").join(thresholds, "vec_id", "left")
        reach = F.when((F.col("threshold") > 0) & (F.col("norm") > 0), F.col("threshold") / F.col("norm")).otherwise(0.0)
        asked = _cut(asked.select("vec_id", "threshold", reach.alias("reach")), ["reach", "vec_id"], query_rows, "asked", "slot")
        in_phase = F.col("bucket").between(start, stop - 1)
        searches = settle(_searches(asked, lengths.where(in_phase)), "searches").df
        slots = searches.agg(F.max("slot")).first()[0]
        if slots is None:  # thresholds only rise and lengths only fall
            break
        found = _meet(_blocks_of(rows.where(in_phase), queries, searches, slots + 1), k, scale)
        found = best.drop("rank").unionByName(found)
        best = settle(found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k), "best").df
    return best.select("query_id", "rank", "vec_id", "score")
