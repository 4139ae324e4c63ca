"""Sinks: managed tables, Parquet and CSV.

Data are replaced as a whole: the new rows are written beside the old ones, which stay until
that has worked. A run that dies on the way leaves the old rows readable, and a frame may
replace the data it reads from.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Nothing is trimmed.
CSV_WRITTEN = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "emptyValue": '""',
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


# Rows of a CSV file. One task reads a file whose texts may hold line breaks, so this bounds its work.
CSV_ROWS = 1_000_000


def _replaced(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write to a folder beside ``path``, then put it in the place of what is there."""
    hadoop, mark = spark._jvm.org.apache.hadoop.fs.Path, uuid.uuid4().hex
    target = hadoop(path)
    # Readers of the parent folder pass over names that begin with an underscore.
    new, old = (hadoop(target.getParent(), f"_{target.getName()}-{label}-{mark}") for label in ("new", "old"))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(new.toString())
        there = files.exists(target)
        if there and not files.rename(target, old):
            raise OSError(f"cannot move {target}")
        if not files.rename(new, target):
            if there:
                files.rename(old, target)
            raise OSError(f"cannot move {new} to {target}")
        if there:
            files.delete(old, True)
    finally:
        files.delete(new, True)


def write_table(frame: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Replace a managed table, data and schema, and read it back.

    ``fmt`` is any table format the session has a source for, ``delta`` included, which
    replaces as a whole by itself.
    """
    spark = frame.sparkSession
    if fmt == "delta":
        frame.write.format(fmt).mode("overwrite").option("overwriteSchema", "true").saveAsTable(name)
        return spark.read.table(name)
    staged = f"{name}_{uuid.uuid4().hex}"
    try:
        frame.write.format(fmt).saveAsTable(staged)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
    return spark.read.table(name)


def write_parquet(frame: DataFrame, path: str, single_part: bool = False) -> DataFrame:
    """Replace a Parquet dataset and read it back.

    ``single_part`` makes one file that is easy to download, at any size. One task writes
    it, so it is for results whose size the taxonomy or a sample size bounds.
    """
    if single_part:
        # repartition, not coalesce: the work before the write keeps its parallelism.
        frame = frame.repartition(1)
    _replaced(frame.sparkSession, path, frame.write.parquet)
    return frame.sparkSession.read.parquet(path)


def write_csv(frame: DataFrame, path: str, rows_per_file: int = CSV_ROWS) -> None:
    """Replace a CSV dataset with a header line per part file and no index column.

    No file has more than ``rows_per_file`` rows.

    Texts come back as they are, with padding, quotes, commas, backslashes and line breaks;
    only the empty text comes back as null, which CSV readers don't tell apart.
    """
    writer = frame.write.options(**CSV_WRITTEN).option("maxRecordsPerFile", rows_per_file)
    _replaced(frame.sparkSession, path, writer.csv)


def export_dataframe(
    frame: DataFrame,
    table_name: str,
    parquet_path: str,
    single_part: bool = False,
    fmt: str = "parquet",
) -> DataFrame:
    """Save as a table, then export the stored table to Parquet.

    The plan runs once: the Parquet copy is made from the stored table.
    """
    stored = write_table(frame, table_name, fmt)
    return write_parquet(stored, parquet_path, single_part)


@contextmanager
def kept(frame: DataFrame) -> Iterator[DataFrame]:
    """Keep a reused result on the executors for the length of a block, then release it.

    A lost executor costs a recomputation of its share, nothing more.
    """
    frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield frame
    finally:
        frame.unpersist()
