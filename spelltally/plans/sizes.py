"""Firm-size distributions of all and of focal employees."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spelltally.config import Study
from spelltally.operators import sizes as size_ops
from spelltally.plans.firms import firm_employee_counts, firm_focal_counts

COUNTS = {
    "employee_count": firm_employee_counts,
    "focal_employee_count": firm_focal_counts,
}


def _sizes(tables, study: Study, name: str) -> DataFrame:
    return size_ops.size_table(COUNTS[name](tables, study), name)


def statistics(tables, study: Study, name: str = "employee_count") -> DataFrame:
    return size_ops.size_statistics(_sizes(tables, study, name), name)


def description(tables, study: Study, name: str = "employee_count") -> DataFrame:
    return size_ops.size_description(_sizes(tables, study, name), name)


def cutoff(tables, study: Study, name: str = "employee_count") -> DataFrame:
    return size_ops.truncation(_sizes(tables, study, name), name, study.truncation_quantile)


def histogram(tables, study: Study, name: str = "employee_count") -> DataFrame:
    return size_ops.truncated_histogram(
        _sizes(tables, study, name), name, study.truncation_quantile
    )
