"""Batches of texts of similar length, with the least padding.

The histogram of all lengths grows far slower than the texts. Dynamic
programming over it finds the bucket boundaries for which padding every text
to its bucket's boundary costs least. Inside a bucket texts are taken in order
of ``doc_id`` and cut into batches that fit the token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentdup.llm.ordering import number_within
from contentdup.operators.settle import settle

BUCKETS = 8
BATCH_TOKENS = 16_384
WORD = r"[^\x20\x09-\x0D]+"


def _next_level(best: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least totals with one bucket more, and where that bucket begins.

    A longer last boundary never moves the best beginning of its bucket to the
    left, so the lengths are halved again and again, and each half looks only
    where its neighbours allow. Of equal totals the lowest beginning counts.
    """
    n = len(lengths)
    following, choice = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    todo = [(1, n, 0, n - 1)]
    while todo:
        low, high, left, right = todo.pop()
        if low > high:
            continue
        middle = (low + high) // 2
        end = min(right, middle - 1) + 1
        costs = best[left:end] + lengths[middle - 1] * (before[middle] - before[left:end])
        at = int(costs.argmin())
        following[middle], choice[middle] = costs[at], left + at
        todo += [(low, middle - 1, left, left + at), (middle + 1, high, left + at, right)]
    return following, choice


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries, ascending, of at most ``buckets`` buckets that minimise the
    padded total. ``lengths`` are distinct and ascending. With equal totals
    fewer buckets win, then lower boundaries."""
    n = len(lengths)
    if not n:
        return []
    before = np.append(0, np.cumsum(counts)).astype(np.int64)
    best = np.append(0, lengths * before[1:]).astype(np.int64)
    choices = [np.zeros(n + 1, np.int64)]
    totals = [best[n]]
    for _ in range(1, min(buckets, n)):
        best, choice = _next_level(best, lengths, before)
        choices.append(choice)
        totals.append(best[n])
    used = int(np.argmin(totals))
    found, j = [], n
    for level in range(used, -1, -1):
        if j == 0:
            break
        found.append(int(lengths[j - 1]))
        j = int(choices[level][j])
    return sorted(set(found))


def pack_documents(docs: DataFrame, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Place every text in a batch.

    Returns ``doc_id, n_tokens`` (words), ``bucket`` (from 0), ``padded_to``
    (its boundary), ``batch`` (from 0 in its bucket) and ``place`` (from 0 in
    its batch). A batch holds as many texts as fit ``batch_tokens`` at the
    boundary's length, at least one.

    Boundaries are optimal at every length, however long a text is; the
    boundary of a bucket is the length of its longest text. The histogram has
    one row per distinct length: d of them need d^2 / 2 words, so a corpus of
    w words has at most (2 w)^0.5, six million in 100 TB of text.

    A null or empty text has no tokens. Rows without ``doc_id`` come first in
    their bucket; repeated rows are each placed. Further columns are ignored;
    an empty table gives no rows.
    """
    n_tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = settle(docs.select("doc_id", n_tokens.alias("n_tokens")), "lengths").df
    histogram = sized.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow()
    lengths, counts = (histogram.column(c).to_numpy() for c in ("n_tokens", "n"))
    order = np.argsort(lengths)
    boundaries = best_boundaries(lengths[order], counts[order], buckets)
    bucket, edge = F.lit(0), F.lit(0)
    for number, boundary in reversed(list(enumerate(boundaries))):
        inside = F.col("n_tokens") <= boundary
        bucket = F.lit(number) if number == len(boundaries) - 1 else F.when(inside, number).otherwise(bucket)
        edge = F.lit(boundary) if number == len(boundaries) - 1 else F.when(inside, boundary).otherwise(edge)
    rows = sized.select("*", bucket.cast("int").alias("bucket"), edge.cast("bigint").alias("padded_to"))
    placed = number_within(rows, "bucket", ["doc_id", "n_tokens"], "packed")
    size = F.greatest(F.floor(F.lit(batch_tokens) / F.greatest("padded_to", F.lit(1))), F.lit(1))
    return placed.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "padded_to",
        F.floor((F.col("pos") - 1) / size).cast("bigint").alias("batch"),
        F.pmod(F.col("pos") - 1, size).cast("bigint").alias("place"),
    )
