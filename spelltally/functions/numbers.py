"""Ratios which survive an empty denominator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def ratio_or_null(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)


def percent(share: Column) -> Column:
    return share * 100


def zero_if_null(count: Column) -> Column:
    return F.coalesce(count, F.lit(0)).cast("long")
