"""How the given tables are read as corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentdup.sources.tables import table_items


# Columns the queries use; with the schema given, no file is opened to plan.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "orders": "o_orderkey bigint, o_custkey bigint",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _document_path(source, name):
    return F.concat(F.lit("/"), source, F.lit("/"), "lang", F.lit("/"), name)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as the file ``/source/lang/doc_id.txt``."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return table_items(table(spark, folder, "documents"), _document_path(F.col("source"), name), F.col("text"))


# What stands before and after a path, by doc_id modulo 6.
ODD_NAMES = [(" /", ""), ("/", " "), ('/q"u,', ',"'), ("/back\\", "\\"), ("/line\n", "\n"), ("/cr\r", "\r\n'")]


def oddly_named_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose paths hold what separates or quotes values in files."""
    number = F.col("doc_id") % len(ODD_NAMES)
    path = F.col("doc_id").cast("string")
    for turn, (before, after) in enumerate(ODD_NAMES):
        path = F.when(number == turn, F.concat(F.lit(before), F.col("doc_id").cast("string"), F.lit(after))).otherwise(path)
    return table_items(table(spark, folder, "documents"), path, F.col("text"))


def marked_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The same with hidden folders (sources that end in 3), hidden files
    (under 200 characters) and links (Spanish, over 2,000 characters)."""
    source = F.when(F.col("source").endswith("3"), F.concat(F.lit("."), "source")).otherwise(F.col("source"))
    name = F.concat(
        F.when(F.col("n_chars") < 200, F.lit(".")).otherwise(F.lit("")),
        F.col("doc_id").cast("string"),
        F.lit(".txt"),
    )
    return table_items(
        table(spark, folder, "documents"),
        _document_path(source, name),
        F.col("text"),
        is_symlink=(F.col("lang") == "es") & (F.col("n_chars") > 2000),
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat(F.lit("/pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    return table_items(table(spark, folder, "pages"), path, F.col("html"))


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat(
        F.lit("/"), "role", F.lit("/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")
    )
    return table_items(table(spark, folder, "conversations"), path, F.col("text"))


def versioned_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with ``version``, a number that would change with the text,
    and ``doc_id``."""
    rows = table(spark, folder, "documents")
    path = _document_path(F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    items = table_items(rows, path, F.col("text"))
    doc_id = F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("bigint")
    return items.withColumns({"doc_id": doc_id, "version": doc_id % 3 + 10})


def altered_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each document, one with another last byte below ``/tail``, and one with
    another byte at 5,001 (where there is one) below ``/gap``."""
    items = documents(spark, folder).where("size_bytes > 0")
    content, size = F.col("content"), F.col("size_bytes").cast("int")
    tail = F.concat(F.substring(content, F.lit(1), size - 1), F.lit(b"\x01"))
    gap = F.concat(F.substring(content, 1, 5000), F.lit(b"\x02"), F.substring(content, F.lit(5002), size))

    def under(name, changed):
        return {"path": F.concat(F.lit(name), "path"), "content": changed}

    return items.unionByName(items.withColumns(under("/tail", tail))).unionByName(
        items.where("size_bytes > 5001").withColumns(under("/gap", gap))
    )


def partly_empty_documents(spark: SparkSession, folder: str, stored_size: bool = True) -> DataFrame:
    """Documents with or without a stored size; every ninth has lost its text."""
    rows = table(spark, folder, "documents")
    path = _document_path(F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    text = F.when(F.col("doc_id") % 9 != 0, F.col("text"))
    return table_items(rows, path, text, size=F.octet_length("text") if stored_size else None)


def earlier_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with ``version`` as they may have been before: without every
    tenth, another tenth with a longer text, and one tenth there twice."""
    rows = table(spark, folder, "documents").where("doc_id % 10 <> 3")
    changed = F.col("doc_id") % 10 == 4
    text = F.when(changed, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    path = _document_path(F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    items = table_items(rows, path, text, modified=F.when(changed, 0).otherwise(1), size=F.octet_length(text))
    gone = table_items(
        rows.where("doc_id % 10 = 5"), F.concat(F.lit("/gone"), path), F.col("text"), modified=F.lit(1), size=F.octet_length("text")
    )
    return items.unionByName(gone).withColumnRenamed("modified", "version")


def current_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The same as they are now; of the new ones every other has lost its text
    but for its size."""
    rows = table(spark, folder, "documents")
    path = _document_path(F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    text = F.when(F.col("doc_id") % 20 != 3, F.col("text"))
    items = table_items(rows, path, text, modified=F.lit(1), size=F.octet_length("text"))
    return items.withColumnRenamed("modified", "version")


def arriving_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a time of arrival, in four turns one after the other."""
    turn = F.col("doc_id") % 4
    arrived = F.timestamp_seconds(turn * 10_000_000 + F.col("doc_id") % 10_000_000)
    path = _document_path(F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    rows = table(spark, folder, "documents").withColumn("turn", turn)
    items = table_items(rows.withColumn("arrived", arrived), path, F.col("text"), modified=F.col("arrived"))
    number = F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("bigint")
    return items.withColumnRenamed("modified", "arrived").withColumn("turn", number % 4)
