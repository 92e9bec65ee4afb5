"""The pipeline, stage by stage, against what its operators say."""

import duckdb
import pytest
from pyspark.sql import Row

import corpus_pipeline as pipeline
from contentdup.llm.ngram_join import ngram_components
from contentdup.llm.pii import base_spans
from contentdup.llm.quality import score_quality
from contentdup.llm.queries import op8_quality_rules, training_labels
from tests.llm.test_join import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = [docs.collect()]
    for _, stage in pipeline.STAGES:
        docs = spark.createDataFrame(found[-1], docs.schema)
        docs = stage(spark, docs, FOLDER)
        found.append(docs.collect())
    return found


def ids(rows):
    return [row.doc_id for row in rows]


def test_columns(stages):
    assert all(set(rows[0].asDict()) == set(pipeline.COLUMNS) for rows in stages[:-1])


def test_classifier_drops_what_it_rejects(spark, stages):
    docs = spark.createDataFrame(stages[0])
    accepted = score_quality(docs, training_labels(spark, FOLDER)).where("predicted = 1")
    assert sorted(ids(stages[1])) == sorted(ids(accepted.collect()))


def test_clean_documents_stay(stages):
    rows = duckdb.sql(f"SELECT doc_id FROM '{FOLDER}/labels.parquet' WHERE quality = 1").fetchall()
    good = {i for (i,) in rows} & {row.doc_id for row in stages[0] if len(row.text.split()) >= 60}
    assert len(good & set(ids(stages[2]))) >= 0.9 * len(good)


def test_rules_keep_what_op8_keeps(spark, stages):
    kept = {row.doc_id for row in op8_quality_rules(spark, FOLDER).where("kept").collect()}
    assert sorted(ids(stages[2])) == sorted(i for i in ids(stages[1]) if i in kept)


def test_rules_reject_what_the_classifier_missed(spark, stages):
    verdicts = op8_quality_rules(spark, FOLDER).where("NOT kept AND NOT base_failed").select("doc_id").collect()
    missed = [row for row in stages[0] if row.doc_id in ids(verdicts)]
    assert missed
    # Under ids without a label, beside rows of one class only.
    again = [Row(**(row.asDict() | {"doc_id": -row.doc_id - 1})) for row in missed]
    docs = spark.createDataFrame(stages[1]).unionByName(spark.createDataFrame(again))
    assert sorted(ids(pipeline.quality_rules(spark, docs, FOLDER).collect())) == sorted(ids(stages[2]))


def test_one_document_of_each_group_stays(stages):
    placed = brute([(row.doc_id, row.text) for row in stages[2]], 5, 80, 100)
    assert sorted(ids(stages[3])) == sorted(i for i, _, group in placed if i == group)


def test_no_base_span_is_left(stages):
    assert ids(stages[3]) and sorted(ids(stages[4])) == sorted(ids(stages[3]))
    assert not [row.doc_id for row in stages[4] if base_spans(row.text)]
    assert all(row.n_chars == len(row.text) for row in stages[4])


def test_every_document_is_packed(stages):
    assert sorted(ids(stages[5])) == sorted(ids(stages[4]))
    places = {(row.bucket, row.batch, row.place) for row in stages[5]}
    assert len(places) == len(stages[5])


def test_run(spark, stages):
    assert sorted(map(repr, pipeline.run(spark, FOLDER).collect())) == sorted(map(repr, stages[-1]))


def test_rows_without_id_pass_the_join(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id bigint, text string")
    docs = docs.selectExpr("*", "'' AS lang", "'' AS source", "1L AS n_chars", "'x' AS name")
    assert sorted(ids(pipeline.near_duplicates(spark, docs, FOLDER).collect()), key=repr) == [1, None]
    assert ngram_components(docs).count() == 3


def test_near_duplicates_go_by_row(spark):
    texts = [" ".join(f"{word}{i}" for i in range(30)) for word in "abcd"]
    rows = [(5, texts[0]), (1, texts[0] + " x"), (5, texts[1]), (5, texts[1]), (7, texts[1]), (5, texts[2])]
    rows += [(None, texts[3]), (None, texts[3]), (None, texts[3] + " x"), (8, ""), (8, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'' AS lang", "'' AS source", "1L AS n_chars")
    left = [(row.doc_id, row.text) for row in pipeline.near_duplicates(spark, docs, FOLDER).collect()]
    without = [text for doc_id, text in left if doc_id is None]
    assert len(without) == 1 and without[0].startswith(texts[3])
    wanted = [(1, texts[0] + " x"), (5, texts[1]), (5, texts[2]), (8, ""), (8, ""), (9, None)]
    assert sorted((row for row in left if row[0] is not None), key=repr) == sorted(wanted, key=repr)


def odd_documents(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return docs.selectExpr("*", "'en' AS lang", "'web' AS source", "1L AS n_chars", "1 AS row_id", "'x' AS name", "2 AS bucket")


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stages_on_empty_tables_and_odd_texts(spark, name, stage):
    assert stage(spark, odd_documents(spark, []), FOLDER).count() == 0
    long = " ".join(f"word{i % 997} other{i}" for i in range(60_000))
    rows = [(1, long), (1, long), (2, long + " end"), (None, "short"), (3, None), (4, ""), (5, "x" * 200_000)]
    left = stage(spark, odd_documents(spark, rows), FOLDER).collect()
    if name in ("personal_data", "packing"):
        assert len(left) == len(rows)
    elif name == "near_duplicates":
        assert sorted(((r.doc_id, len(r.text or "")) for r in left), key=repr) == sorted(
            [(1, len(long)), (None, 5), (3, 0), (4, 0), (5, 200_000)], key=repr
        )
    else:
        assert len(left) <= len(rows)
