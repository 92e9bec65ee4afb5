"""Every registered query against its SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    return tuple(value) if isinstance(value, list) else value


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() == 21


@pytest.mark.parametrize("name", list(entry_point.queries()))
def test_query(spark, sql, name):
    result = entry_point.queries()[name](spark, FOLDER)
    columns = sorted(result.columns)
    found = sorted(tuple(repr(plain(row[c])) for c in columns) for row in result.collect())
    statement = entry_point.oracle_sql().get(name)
    if statement is None:
        assert found
        return
    cursor = sql.execute(statement)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    wanted = sorted(tuple(repr(plain(row[names.index(c)])) for c in columns) for row in cursor.fetchall())
    assert found == wanted
