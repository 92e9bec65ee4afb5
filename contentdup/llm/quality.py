"""Quality scores: a Gaussian kernel over document statistics.

Random Fourier features turn the standardised statistics into a space where
ridge regression approximates kernel regression. Its normal equations are sums
over rows: each partition adds up its own, and the small matrices are added in
a second step. Isotonic regression on rows that the fit has not seen turns the
fitted values into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentdup.llm.common import slices, text_bytes, texts
from contentdup.llm.hashing import Words
from contentdup.llm.stats import FEATURES, document_features
from contentdup.operators.settle import settle
from contentdup.ship import ship

COMPONENTS = 256
RIDGE = 1.0
# Statistics are cut at this many deviations, as the kernel sees nothing there.
REACH = 4.0
CALIBRATION_BINS = 2000
# Partial sums are added up in this many tasks before they meet.
SUM_TASKS = 16


def feature_table(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of every whole text (null: empty)."""
    ship(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = _measured(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, rows.T)], ["doc_id", *FEATURES])

    return texts(docs).mapInArrow(measure, ", ".join(["doc_id bigint", *(f"{name} double" for name in FEATURES)]))


def _measured(column: pa.Array) -> np.ndarray:
    return document_features(Words.of(*text_bytes(column), fold=False), column.to_pylist())


@dataclass(frozen=True)
class QualityModel:
    means: np.ndarray
    scales: np.ndarray
    beta: np.ndarray
    # Fitted values and the probabilities at them, both ascending.
    knots: np.ndarray
    levels: np.ndarray

    @property
    def waves(self) -> tuple[np.ndarray, np.ndarray]:
        """Frequencies and phases; the kernel's width is the root of the number
        of statistics, the usual distance of standardised rows."""
        source = np.random.default_rng(2)
        width = np.sqrt(len(FEATURES))
        return source.normal(size=(len(FEATURES), COMPONENTS)) / width, source.uniform(0, 2 * np.pi, COMPONENTS)

    def components(self, rows: np.ndarray) -> np.ndarray:
        frequencies, phases = self.waves
        near = np.clip((rows - self.means) / self.scales, -REACH, REACH)
        return np.column_stack([np.sqrt(2 / COMPONENTS) * np.cos(near @ frequencies + phases), np.ones(len(rows))])

    def fitted(self, rows: np.ndarray) -> np.ndarray:
        return self.components(rows) @ self.beta

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(self.fitted(rows), self.knots, self.levels)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(name).to_numpy(zero_copy_only=False) for name in FEATURES])


def _summed(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over all rows; ``rows`` hold the statistics and ``quality``."""
    size = COMPONENTS + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = model.components(_rows(batch))
            total += z.T @ np.column_stack([z, batch.column("quality").to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            for sums in batch.column("sums"):
                total += np.frombuffer(sums.as_buffer()).reshape(size, size + 1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    partials = rows.select(*FEATURES, "quality").mapInArrow(partial, "sums binary")
    added = partials.repartition(SUM_TASKS).mapInArrow(add, "sums binary")
    total = sum((np.frombuffer(row.sums).reshape(size, size + 1) for row in added.collect()), np.zeros((size, size + 1)))
    return total[:, :-1], total[:, -1]


def _isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing fit by pooling neighbours that violate the order."""
    blocks: list[list[float]] = []
    for value, weight in zip(values, weights):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            last, before = blocks.pop(), blocks[-1]
            both = before[1] + last[1]
            before[0] = (before[0] * before[1] + last[0] * last[1]) / both
            before[1], before[2] = both, before[2] + last[2]
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def train_quality_model(features: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on all rows of ``features`` with a row in ``labels`` (``doc_id,
    quality`` 0 or 1), but a third of them, chosen by ``doc_id``, which
    calibrates. ``features`` should be a written table.

    A document labelled more than once takes the lower label. Without
    labelled rows every score is 0.5.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    single = usable.groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    rows = settle(features.join(single, "doc_id").withColumn("fold", fold), "quality-rows").df
    fit = rows.where("fold > 0")
    moments = fit.agg(
        F.count(F.lit(1)).alias("n"),
        *(F.avg(c).alias(f"m_{c}") for c in FEATURES),
        *(F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES),
    ).first()
    flat = np.zeros(COMPONENTS + 1)
    if not moments.n:
        return QualityModel(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), flat, np.zeros(1), np.full(1, 0.5))
    # Rounding keeps a fit from following the order in which sums were made.
    means = np.array([round(moments[f"m_{c}"], 9) for c in FEATURES])
    scales = np.array([max(round(moments[f"s_{c}"], 9), 1e-6) for c in FEATURES])
    model = QualityModel(means, scales, flat, np.zeros(1), np.zeros(1))
    gram, right = _summed(fit, model)
    beta = np.linalg.solve(gram + RIDGE * np.eye(len(gram)), right)
    model = QualityModel(means, scales, beta, model.knots, model.levels)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.clip(np.floor((model.fitted(_rows(batch)) + 0.5) / 2 * CALIBRATION_BINS), 0, CALIBRATION_BINS - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place.astype(np.int32)), batch.column("quality")], ["bin", "quality"]
            )

    held = rows.where("fold = 0").select(*FEATURES, "quality").mapInArrow(bins, "bin int, quality double")
    table = held.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("k")).orderBy("bin").collect()
    if not table:
        return QualityModel(means, scales, beta, np.zeros(1), np.full(1, 0.5))
    centres = (np.array([row.bin for row in table]) + 0.5) / CALIBRATION_BINS * 2 - 0.5
    n, k = (np.array([row[c] for row in table], float) for c in ("n", "k"))
    return QualityModel(means, scales, beta, centres, _isotonic(k / n, n))


def score_features(features: DataFrame, model: QualityModel, threshold: float) -> DataFrame:
    """``doc_id, score, predicted``: the probability of label 1, and whether it
    reaches ``threshold``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.round(np.clip(model.probability(_rows(batch)), 0, 1), 9)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    return features.mapInArrow(score, "doc_id bigint, score double, predicted int")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Train on ``labels`` and score every row of ``docs``.

    Only the text decides a score. A null text counts as empty, and empty
    texts are scored as such. One row per input row, whatever ``doc_id``
    holds; repeated rows get equal scores; further columns are ignored; an
    empty table gives no rows.
    """
    features = settle(feature_table(docs), "document-features").df
    return score_features(features, train_quality_model(features, labels), threshold)


def keep_by_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all columns.

    Scores are those of :func:`score_quality`; the statistics are computed a
    second time, which costs less than a shuffle of the texts.
    """
    model = train_quality_model(settle(feature_table(docs), "document-features").df, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = model.probability(_measured(batch.column("text").fill_null("")))
            yield batch.filter(pa.array(np.round(np.clip(p, 0, 1), 9) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
