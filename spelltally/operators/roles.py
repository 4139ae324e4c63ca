"""Role composition and concentration of user-firm pairs.

Pairs are counted once by category and role; what follows runs on that table, which the
role taxonomy bounds (about 1,500 levels per category).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spelltally.config import MISSING
from spelltally.functions.numbers import ratio_or_null


def role_composition(primary: DataFrame, role: str, all_sample: str) -> DataFrame:
    """Counts, shares, ranks and running shares per role, for all pairs and per category."""
    pairs = primary.groupBy("job_category", role).agg(F.count(F.lit(1)).alias("_pairs"))
    samples = (
        pairs.groupingSets([[role], ["job_category", role]], "job_category", role)
        .agg(
            F.sum("_pairs").alias("employee_firm_count"),
            F.grouping("job_category").alias("_all"),
        )
        .select(
            F.when(F.col("_all") == 1, F.lit(all_sample))
            .otherwise(F.col("job_category"))
            .alias("sample"),
            role,
            "employee_firm_count",
        )
    )
    sample = W.partitionBy("sample")
    ranked = sample.orderBy(F.desc("employee_firm_count"), F.asc(role))
    up_to_here = ranked.rowsBetween(W.unboundedPreceding, W.currentRow)
    count, total = F.col("employee_firm_count"), F.col("denominator_employee_firms")
    return (
        samples.withColumn("denominator_employee_firms", F.sum(count).over(sample))
        .withColumn("rank", F.row_number().over(ranked))
        .withColumn("cumulative_share", F.sum(count).over(up_to_here) / total)
        .select(
            "sample",
            role,
            "employee_firm_count",
            "denominator_employee_firms",
            (count / total).alias("employee_firm_share"),
            F.col("rank").cast("long").alias("rank"),
            "cumulative_share",
        )
    )


def role_concentration(composition: DataFrame) -> DataFrame:
    """Top shares, sum of squared shares and its inverse, per sample."""
    share = F.col("employee_firm_share")

    def top(number: int):
        return F.sum(F.when(F.col("rank") <= number, share)).alias(f"top_{number}_share")

    return (
        composition.groupBy("sample")
        .agg(
            F.max("denominator_employee_firms").alias("employee_firm_count"),
            F.count(F.lit(1)).alias("distinct_role_count"),
            top(5),
            top(10),
            top(20),
            F.sum(share * share).alias("herfindahl_index"),
        )
        .withColumn(
            "effective_role_count", ratio_or_null(F.lit(1.0), F.col("herfindahl_index"))
        )
    )


def top_roles_overall(composition: DataFrame, all_sample: str, number: int) -> DataFrame:
    return composition.where((F.col("sample") == all_sample) & (F.col("rank") <= number)).orderBy(
        F.asc("employee_firm_share"), F.desc("rank")
    )


def top_roles_by_category(
    composition: DataFrame, categories: tuple[str, ...], number: int
) -> DataFrame:
    return composition.where(
        F.col("sample").isin(*categories) & (F.col("rank") <= number)
    ).orderBy("sample", F.asc("employee_firm_share"), F.desc("rank"))


def role_selection_diagnostics(summary: DataFrame) -> DataFrame:
    """Named metrics on how one role was chosen per pair, with shares of all pairs."""
    figures = summary.agg(
        F.coalesce(F.sum("spell_rows"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(F.col("several_roles")).alias("roles"),
        F.count_if(F.col("several_categories")).alias("categories"),
        F.count_if(F.col("primary_role") == MISSING).alias("missing"),
    )

    def metric(name: str, value: str, shared: bool = True):
        share = ratio_or_null(F.col(value), F.col("pairs")) if shared else F.lit(None)
        return F.struct(
            F.lit(name).alias("metric"),
            F.col(value).alias("value"),
            share.cast("double").alias("share_of_employee_firm_pairs"),
        )

    return figures.select(
        F.inline(
            F.array(
                metric("active_focal_position_rows", "rows", shared=False),
                metric("active_focal_employee_firm_pairs", "pairs"),
                metric("employee_firm_pairs_with_multiple_roles", "roles"),
                metric("employee_firm_pairs_with_multiple_categories", "categories"),
                metric("employee_firm_pairs_with_missing_primary_role", "missing"),
            )
        )
    )
