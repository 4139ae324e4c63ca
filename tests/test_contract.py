"""Each registered query against its SQL twin on the smallest provided data."""

import os

import pytest
from compare import connect, duck_rows, duck_types, spark_rows, spark_types

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the provided data")

ROWS_ONLY = {"sample_limit"}


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_a_twin():
    own = set(contract.queries()) - set(contract.corpus_queries()[0])
    assert own - set(contract.oracle_sql()) == ROWS_ONLY
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", contract.QUERIES)
def test_query(spark, connection, name):
    frame = contract.queries()[name](spark, FOLDER)
    columns, rows = spark_rows(frame)
    if name in ROWS_ONLY:
        assert len(rows) == contract.STUDY.sample_size
        return
    sql = contract.oracle_sql()[name]
    assert spark_types(frame) == duck_types(connection, sql)
    other_columns, other_rows = duck_rows(connection, sql)
    assert columns == other_columns
    assert rows == other_rows


def test_entry(spark):
    frame = contract.entry(spark)
    rows = frame.collect()
    assert frame.columns == ["hq_country", "company_count"]
    assert len(rows) == 26 and sum(row[1] for row in rows) == 86


def test_flagship_value(spark):
    folder = "/root/testdata/sf0.01"
    rows = contract.QUERIES["active_by_country"](contract.ProvidedTables(spark, folder)).collect()
    assert len(rows) == 26 and sum(row[1] for row in rows) == 902
    assert [tuple(row) for row in rows[:4]] == [
        ("Missing", 66), ("NATION_10", 44), ("NATION_2", 42), ("NATION_7", 42),
    ]
