"""Documents to packed training batches, one text operator per stage.

Every stage takes what its predecessor kept, as written and read again, and
all but the last return the columns of ``documents``. Columns that are named
alike in other tables do no harm, since every stage selects what it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentdup.llm.common import read_table
from contentdup.llm.ngram_join import ngram_components
from contentdup.llm.packing import pack_documents
from contentdup.llm.pii import mask_personal_data
from contentdup.llm.quality import keep_by_quality
from contentdup.llm.queries import training_labels
from contentdup.llm.rules import keep_by_rules, train_rule_model
from contentdup.operators.among import without
from contentdup.operators.settle import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
QUALITY_THRESHOLD = 0.7


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the kernel classifier scores below 0.7. Null and
    empty texts are scored as texts without words; rows that repeat are scored
    alike, each by its own text. An empty table gives an empty one; texts of any
    length count whole."""
    return keep_by_quality(docs.select(*COLUMNS), training_labels(spark, sf_dir), QUALITY_THRESHOLD)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the fixed rules or the regression reject. The
    regression learns from all documents, as in op8: what the stage before
    left has hardly a row of low quality. Null and empty texts have no words and
    go; rows that repeat are judged alike, each by its own text. An empty table
    gives an empty one; texts of any length count whole."""
    model = train_rule_model(read_table(spark, sf_dir, "documents"), training_labels(spark, sf_dir))
    return keep_by_rules(docs.select(*COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group that shares 80 % of its five-word shingles:
    the one with the smallest ``doc_id``, and of several such rows the one with
    the smallest hash of the row. Groups are made of rows, which are numbered as
    they are written, so no two share a key: rows of another group under the
    same ``doc_id`` stay. Rows without ``doc_id`` belong to groups too; such a
    row does not stand for one with an id, so a group keeps one of each kind.
    Rows without words (null or empty) are no copies of anything and stay. An
    empty table gives an empty one; texts of any length are compared whole.
    """
    rows = docs.select(*COLUMNS).withColumns({"row_hash": F.xxhash64(*COLUMNS), "row_id": F.monotonically_increasing_id()})
    rows = settle(rows, "numbered-rows").df
    placed = ngram_components(rows.select(F.col("row_id").alias("doc_id"), "text"), n=5, num=80, den=100)
    placed = placed.where("n_shingles > 0").select(F.col("doc_id").alias("row_id"), "component_id")
    grouped = settle(rows.select("row_id", "doc_id", "row_hash").join(placed, "row_id"), "grouped-rows").df
    first = grouped.groupBy("component_id", F.col("doc_id").isNull().alias("without_id")).agg(
        F.min(F.struct("doc_id", "row_hash", "row_id")).alias("first")
    )
    dropped = settle(grouped.join(first.select("first.row_id"), "row_id", "left_anti").select("row_id"), "near-copies")
    # Texts stay where they are, but for those that the bit table does not clear.
    return without(rows, dropped.df, dropped.n_rows, "row_id").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; ``n_chars`` follows the text. No row
    goes; null texts stay null, repeats are masked alike, texts of any length
    whole. An empty table gives an empty one."""
    masked = mask_personal_data(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of similar length: one row per document with its place. Null and
    empty texts have length 0, rows that repeat have a place each, a text longer
    than a batch is one of its own. An empty table gives an empty one."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

# Trained models decide which rows remain, so SQL cannot give them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name).df
    return docs
