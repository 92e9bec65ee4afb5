"""Small tables with the cases every operator has to stand."""

from pyspark.sql import functions as F

LONG = "word " * 30_000 + "x" * 100_000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today."),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, LONG),
    (6, "Mail a.b@example.com or call +1 (504) 555-2652, host 10.0.0.1, card 4111 1111 1111 1111."),
    (6, "Mail a.b@example.com or call +1 (504) 555-2652, host 10.0.0.1, card 4111 1111 1111 1111."),
    (7, "Größe Σας <|endoftext|> don't ẍ \x1c\x85 １２３ 😀😀 a\u0308"),
    (None, "a row without an id"),
]


def documents(spark, rows=TEXTS):
    """With columns that clash with names the operators use inside."""
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    extra = ["name", "n", "part", "slot", "score", "bucket", "quality", "piece", "label", "fold", "root"]
    return docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1).cast("bigint"), **{c: F.lit(c) for c in extra}})


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int").withColumn("text", F.lit("clash"))


def rows_of(frame, *columns):
    return sorted((tuple(row[c] for c in columns or frame.columns) for row in frame.collect()), key=repr)
