import os

import pytest

from spelltally.llm import queries

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the provided data")
SCHEMA = "doc_id long, text string, source string, size string, score string"
# Nulls, empty and long texts, ties, repeated rows and columns named like results.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog", "a", "x", "y"),
    (1, "The quick brown fox jumps over the lazy dog", "a", "x", "y"),
    (2, None, None, None, None),
    (3, "", "b", "", ""),
    (None, "a null id", "b", "x", None),
    (4, "word " * 60_000, "a", "x", "y"),
    (5, " \t\n", None, "x", "y"),
    (6, "The quick brown fox jumps over the lazy dog", "b", "x", "y"),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def provided(spark):
    """Results of the registered queries, each made once."""
    made = {}

    def get(name):
        if name not in made:
            made[name] = queries.QUERIES[name](spark, FOLDER).toPandas()
        return made[name]

    return get


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas().sort_values("doc_id", ignore_index=True)
