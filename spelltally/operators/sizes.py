"""Firm-size distributions from a frequency table.

N employees in all allow at most sqrt(2N) different firm sizes, a million for half a
trillion employees. So the table of sizes is small at any scale, and the windows
without a partition below run over that table only, never over firms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spelltally.operators.firms import positive


def size_table(counts: DataFrame, name: str) -> DataFrame:
    """Firms with a positive count, per value of the count."""
    return (
        positive(counts, name)
        .groupBy(F.col(name).cast("long").alias(name))
        .agg(F.count(F.lit(1)).alias("company_count"))
    )


def with_cutoff(sizes: DataFrame, name: str, quantile: float) -> DataFrame:
    """Adds the observed value at or just above the quantile's position.

    The position is quantile * (n - 1) counted from zero, rounded up.
    """
    all_sizes = W.partitionBy()
    up_to_here = W.orderBy(name).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum("company_count").over(all_sizes)
    counted = sizes.withColumn("_total", total).withColumn(
        "_running", F.sum("company_count").over(up_to_here)
    )
    reached = F.col("_running") >= F.ceil(F.lit(quantile) * (F.col("_total") - 1)) + 1
    return counted.withColumn(
        "truncation_value", F.min(F.when(reached, F.col(name))).over(all_sizes)
    ).drop("_running", "_total")


def truncation(sizes: DataFrame, name: str, quantile: float) -> DataFrame:
    """One row: the cutoff, the firms counted and the firms above the cutoff."""
    above = F.col(name) > F.col("truncation_value")
    return with_cutoff(sizes, name, quantile).agg(
        F.max("truncation_value").alias("truncation_value"),
        F.sum("company_count").alias("company_count"),
        F.sum(F.when(above, F.col("company_count")).otherwise(0)).alias("number_truncated"),
    )


def truncated_histogram(sizes: DataFrame, name: str, quantile: float) -> DataFrame:
    """Width-one histogram of observed values up to the cutoff."""
    return (
        with_cutoff(sizes, name, quantile)
        .where(F.col(name) <= F.col("truncation_value"))
        .select(name, "company_count")
        .orderBy(name)
    )


def size_description(sizes: DataFrame, name: str) -> DataFrame:
    """One row: count, mean, sample standard deviation, minimum, exact quartiles, maximum.

    The deviation is taken around the mean, so large counts do not cancel digits.
    """
    every = W.partitionBy()
    weight = F.col("company_count")
    centred = sizes.withColumn(
        "_mean", F.sum(F.col(name) * weight).over(every) / F.sum(weight).over(every)
    )
    return centred.agg(
        F.sum(weight).alias("company_count"),
        F.max("_mean").alias("mean"),
        F.sqrt(
            F.try_divide(
                F.sum(weight * (F.col(name) - F.col("_mean")) ** 2), F.sum(weight) - 1
            )
        ).alias("standard_deviation"),
        F.min(name).alias("minimum"),
        F.percentile(name, [0.25, 0.5, 0.75], weight).alias("_quartiles"),
        F.max(name).alias("maximum"),
    ).select(
        "company_count",
        "mean",
        "standard_deviation",
        "minimum",
        F.col("_quartiles")[0].alias("p25"),
        F.col("_quartiles")[1].alias("p50"),
        F.col("_quartiles")[2].alias("p75"),
        "maximum",
    )


def size_statistics(sizes: DataFrame, name: str) -> DataFrame:
    """The figures quoted beside a histogram."""
    return size_description(sizes, name).select(
        "mean", F.col("p50").alias("median"), "p25", "p50", "p75", "standard_deviation"
    )
