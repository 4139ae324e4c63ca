"""Duplicates: one row per key, and distinct pairs.

Each operator is an aggregate, so map tasks collapse a hot key before the shuffle. Those
that pick a row by text columns sort within each task, before the shuffle and after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nulls_last(value: Column) -> Column:
    """Sort key that puts null after every value."""
    return F.struct(value.isNull(), value)


def one_row_per_key(frame: DataFrame, key: str, lead: str | None = None) -> DataFrame:
    """One whole row per key: the smallest by ``lead``, then by the other columns in order.

    Null counts as smallest. Because ``lead`` decides first, a caller who selects only
    the key and ``lead`` gets the same ``lead`` value from a narrower scan.
    """
    rest = [name for name in frame.columns if name not in (key, lead)]
    order = ([lead] if lead else []) + rest
    if not order:
        return frame.distinct()
    return (
        frame.groupBy(key)
        .agg(F.min(F.struct(*order)).alias("_row"))
        .select(*(name if name == key else F.col(f"_row.{name}") for name in frame.columns))
    )


def smallest_per_key(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The smallest value per key, in place of 'first in file order'."""
    return frame.groupBy(*keys).agg(F.min(value).alias(value))


def distinct_pairs(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.select(*columns).distinct()


def observed_combinations(frame: DataFrame, *columns: str) -> DataFrame:
    """All combinations of category levels that occur."""
    return frame.select(*columns).distinct()
