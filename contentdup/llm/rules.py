"""Quality rules: fixed counts, and logistic regression on hashed n-grams.

The regression sees word pairs, single words and character n-grams, hashed
into a table of fixed size, each kind divided by the root of its number. It is
trained on a bounded sample of labelled rows: every part of the sample is
fitted on its own and the weights are averaged. A second, disjoint part of the
sample gives slope and offset of the probabilities (Platt scaling).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentdup.llm.common import slices, text_bytes, texts
from contentdup.llm.hashing import Words, char_grams, word_grams
from contentdup.llm.stats import repeated_lines, repeated_words, symbols, word_chars
from contentdup.operators.settle import settle
from contentdup.ship import ship

BITS = 17
CHARACTERS = 4
# Labelled rows used for training, and the parts they are fitted in.
SAMPLE_ROWS = 20_000
PARTS = 8
EPOCHS = 4
THRESHOLD = 0.5


def hashed_features(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots of each kind of n-gram, with the bounds of the texts in them."""
    kinds = [word_grams(words, 1), word_grams(words, 2), char_grams(words, CHARACTERS)]
    return [
        (((grams ^ np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int32), bounds)
        for kind, (grams, bounds) in enumerate(kinds)
    ]


def margins(features, weights: np.ndarray, bias: float) -> np.ndarray:
    total = np.full(len(features[0][1]) - 1, bias)
    for slots, bounds in features:
        found = weights[slots]
        sums = [found[start:stop].sum(dtype=np.float64) for start, stop in zip(bounds[:-1], bounds[1:])]
        total += np.array(sums) / np.sqrt(np.maximum(np.diff(bounds), 1))
    return total


@dataclass(frozen=True)
class RuleModel:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, words: Words) -> np.ndarray:
        score = self.slope * margins(hashed_features(words), self.weights, self.bias) + self.offset
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def _fit_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """AdaGrad over the rows of one part, in the order they come."""
    rows, labels = [], []
    for batch in slices(batches):
        features = hashed_features(Words.of(*text_bytes(batch.column("text")), fold=False))
        for i, label in enumerate(batch.column("quality").to_pylist()):
            slots, values = [], []
            for found, bounds in features:
                distinct, counts = np.unique(found[bounds[i] : bounds[i + 1]], return_counts=True)
                slots.append(distinct)
                values.append(counts / np.sqrt(max(bounds[i + 1] - bounds[i], 1)))
            rows.append((np.concatenate(slots), np.concatenate(values).astype(np.float32)))
            labels.append(label)
    weights, squares = np.zeros(1 << BITS, np.float32), np.full(1 << BITS, 1e-2, np.float32)
    bias, bias_square = 0.0, 1e-2
    for _ in range(EPOCHS if rows else 0):
        for (slots, values), label in zip(rows, labels):
            margin = min(max(float(weights[slots] @ values) + bias, -30.0), 30.0)
            error = 1 / (1 + np.exp(-margin)) - label
            step = error * values
            squares[slots] += step * step
            weights[slots] -= 0.05 * step / np.sqrt(squares[slots])
            bias_square += error * error
            bias -= 0.05 * error / np.sqrt(bias_square)
    yield pa.RecordBatch.from_arrays(
        [pa.array([len(rows)], pa.int64()), pa.array([bias]), pa.array([weights.tobytes()], pa.binary())],
        ["n", "bias", "weights"],
    )


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row from those of some parts, weighted by their rows; averages of
    averages are the average of all."""
    total, bias, weights = 0, 0.0, np.zeros(1 << BITS)
    for batch in batches:
        for n, part_bias, part in zip(batch.column("n").to_pylist(), batch.column("bias").to_pylist(), batch.column("weights")):
            total, bias = total + n, bias + n * part_bias
            weights += n * np.frombuffer(part.as_buffer(), np.float32).astype(np.float64)
    mean = (weights / max(total, 1)).astype(np.float32)
    yield pa.RecordBatch.from_arrays(
        [pa.array([total], pa.int64()), pa.array([bias / max(total, 1)]), pa.array([mean.tobytes()], pa.binary())],
        ["n", "bias", "weights"],
    )


def _platt(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps; targets are drawn in a little, so
    separable rows stay finite."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, offset = 1.0, 0.0
    rows = np.column_stack([scores, np.ones(len(scores))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * scores + offset, -30, 30)))
        gradient = rows.T @ (p - target) + 1e-3 * np.array([slope - 1, offset])
        hessian = (rows * (p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        slope, offset = slope - move[0], offset - move[1]
        if np.abs(move).max() < 1e-10:
            break
    return (float(slope), float(offset)) if slope > 0 else (1.0, 0.0)


def train_rule_model(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on at most ``sample_rows`` rows of ``labels`` (``doc_id, quality``),
    those with the smallest hash of ``doc_id``; a fifth of them calibrates.

    Without labelled rows the model gives 0.5 to every text.
    """
    spark = docs.sparkSession
    ship(spark)
    key = F.xxhash64("doc_id")
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    # One label per document; of contradicting ones the lower.
    single = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = settle(single.orderBy(key, "doc_id").limit(sample_rows), "rule-labels").df
    # One row per document; of several texts the smallest.
    found = texts(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    rows = found.withColumn("fold", F.pmod(key, F.lit(5)))
    rows = settle(rows, "rule-sample").df.coalesce(4 * PARTS)
    schema = "n bigint, bias double, weights binary"
    fitted = (
        rows.where("fold > 0")
        .repartition(PARTS, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .select("text", "quality")
        .mapInArrow(_fit_part, schema)
        .repartition(4, "bias")
        .mapInArrow(_average, schema)
        .repartition(1)  # at most 4 rows of fixed size
        .mapInArrow(_average, schema)
        .first()
    )
    weights = np.zeros(1 << BITS, np.float32) if fitted is None else np.frombuffer(fitted.weights, np.float32)
    bias = 0.0 if fitted is None else fitted.bias

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = hashed_features(Words.of(*text_bytes(batch.column("text")), fold=False))
            yield pa.RecordBatch.from_arrays(
                [pa.array(margins(found, weights, bias)), batch.column("quality")], ["margin", "quality"]
            )

    held = rows.where("fold = 0").select("text", "quality").mapInArrow(score, "margin double, quality int")
    pairs = sorted((row.margin, row.quality) for row in held.collect())  # a fifth of sample_rows at most
    found = np.array(pairs or np.zeros((0, 2)), float)
    slope, offset = _platt(found[:, 0], found[:, 1])
    return RuleModel(weights, bias, slope, offset)


_SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, p_quality double"
)
_NAMES = [part.split()[0] for part in _SCHEMA.split(", ")]


def apply_rules(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """Counts and verdict for every whole text (null: none, so no words).

    ``base_failed``: under 50 words, or more than half of the words in
    3-word windows that occur twice or more. ``kept``: not failed, and
    ``p_quality`` at least ``threshold``. One row per input row, whatever
    ``doc_id`` holds; further columns are ignored; an empty table gives none.
    """
    ship(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = _judged(batch.column("text"), model, threshold)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], _NAMES)

    return texts(docs).mapInArrow(judge, _SCHEMA)


def _judged(column: pa.Array, model: RuleModel, threshold: float) -> list[np.ndarray]:
    words = Words.of(*text_bytes(column), fold=False)
    n_words, repeated = words.counts, repeated_words(words)
    lines = np.array([repeated_lines(text) for text in column.to_pylist()], np.int64)
    failed = (n_words < 50) | (100 * repeated > 50 * n_words)
    p = np.round(model.probability(words), 9)
    return [n_words, word_chars(words), symbols(words), lines, repeated, failed, ~failed & (p >= threshold), p]


def keep_by_rules(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text :func:`apply_rules` keeps, with all
    columns, in one pass over the texts."""
    ship(docs.sparkSession)
    kept = _NAMES.index("kept") - 1

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(_judged(batch.column("text").fill_null(""), model, threshold)[kept]))

    return docs.mapInArrow(keep, docs.schema)
