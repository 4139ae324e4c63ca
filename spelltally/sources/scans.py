"""Scans. Memory stays bounded by Spark's split size and vectorised reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


CSV_READ = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "multiLine": "true",
    "mode": "FAILFAST",
}


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table or view."""
    return spark.read.table(name)


def scan_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Parquet, read for the named columns only (all of them when none is named)."""
    frame = spark.read.parquet(path)
    return frame.select(*columns) if columns else frame


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, *columns: str
) -> DataFrame:
    """CSV with a header and a declared schema; inference would cost a pass and alter values.

    Texts may hold line breaks, so each file is read by one task; files are as many as the
    tasks that wrote them. A malformed line is an error.
    """
    frame = spark.read.schema(schema).options(**CSV_READ).csv(path)
    return frame.select(*columns) if columns else frame
