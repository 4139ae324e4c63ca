"""Where the source tables come from: a catalog, Parquet folders, or finished extracts.

The plans ask any of these for ``frame(name, *columns)``; ``ProvidedTables`` is a third.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from spelltally.sources.scans import scan_parquet, scan_table


@dataclass(frozen=True)
class CatalogTables:
    spark: SparkSession
    prefix: str = ""

    def frame(self, name: str, *columns: str) -> DataFrame:
        table = scan_table(self.spark, self.prefix + name)
        return table.select(*columns) if columns else table


@dataclass(frozen=True)
class ParquetTables:
    """One Parquet dataset per table. ``extracted`` marks folders written by the extraction."""

    spark: SparkSession
    folder: str
    extracted: bool = False

    def frame(self, name: str, *columns: str) -> DataFrame:
        return scan_parquet(self.spark, f"{self.folder}/{name}", *columns)
