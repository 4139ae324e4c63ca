"""The shared folder for results that are written only to be read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local_folder: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session may go without one; it gets a temporary folder that is
    removed when the process ends.
    """
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="spelltally-")
        atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
    return _local_folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody else writes to."""
    return f"{scratch_root(spark)}/spelltally/{label}-{uuid.uuid4().hex}"


def scratch_table(spark: SparkSession, label: str) -> str:
    """Name for a new managed table in a database that lives in the scratch folder."""
    database = f"scratch_{spark.sparkContext.applicationId.replace('-', '_')}"
    spark.sql(
        f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{scratch_root(spark)}/spelltally/{database}'"
    )
    return f"{database}.{label}_{uuid.uuid4().hex}"
