"""Runs queries in Spark and in DuckDB on the same Parquet files and compares values."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def normal_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is None, str(type(v)), str(v)) for v in row))


def spark_rows(frame):
    return sorted(frame.columns), normal_rows(frame.columns, [tuple(r) for r in frame.collect()])


def duck_rows(connection, sql):
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    return sorted(names), normal_rows(names, result.fetchall())


# How the two engines name the types in use.
TYPES = {
    "bigint": "BIGINT", "string": "VARCHAR", "date": "DATE", "double": "DOUBLE",
    "boolean": "BOOLEAN", "int": "INTEGER",
}


def spark_types(frame):
    return {f.name: TYPES[f.dataType.simpleString()] for f in frame.schema.fields}


def duck_types(connection, sql):
    return {r[0]: r[1] for r in connection.execute(f"DESCRIBE {sql}").fetchall()}


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from conftest import build_session

    import __spark_entry__ as contract

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session()
    connection = connect(folder)
    oracle = contract.oracle_sql()
    for name, query in contract.queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        frame = query(spark, folder)
        columns, rows = spark_rows(frame)
        took = time.time() - began
        if name not in oracle:
            print(f"rows  {name}: {len(rows)} rows {took:.2f}s")
            continue
        same_types = spark_types(frame) == duck_types(connection, oracle[name])
        other_columns, other = duck_rows(connection, oracle[name])
        good = columns == other_columns and rows == other and same_types
        print(f"{'ok   ' if good else 'DIFF '} {name}: {len(rows)} rows {took:.2f}s")
        if not good:
            print("   types", spark_types(frame), duck_types(connection, oracle[name]))
            wrong = [pair for pair in zip(rows, other) if pair[0] != pair[1]][:3]
            print("  ", len(other), wrong)
