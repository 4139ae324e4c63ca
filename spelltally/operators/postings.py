"""Job postings: distinct keys per source, and monthly counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spelltally.functions.dates import dated_within, month_range, month_start, parse_date
from spelltally.operators.dedup import smallest_per_key
from spelltally.operators.firms import FirmUniverse


def posted_within(postings: DataFrame, period: tuple[str, str]) -> DataFrame:
    return postings.where(dated_within(F.col("post_date"), period))


def posting_keys(
    sources: dict[str, DataFrame], universe: FirmUniverse, period: tuple[str, str]
) -> DataFrame:
    """One row per source and job id with its firm, for postings of the period.

    The source is part of the key, as ids may overlap between boards. A job id listed
    under several firms goes to the smallest ``rcid``.
    """
    labelled = [
        universe.keep(posted_within(frame.where("rcid IS NOT NULL AND job_id IS NOT NULL"), period)).select(
            F.lit(source).alias("source"), "job_id", "rcid"
        )
        for source, frame in sources.items()
    ]
    return smallest_per_key(reduce(DataFrame.unionByName, labelled), ["source", "job_id"], "rcid")


def postings_per_firm(keys: DataFrame) -> DataFrame:
    return keys.groupBy("rcid").agg(F.count("job_id").alias("posting_count"))


def monthly_counts(postings: DataFrame) -> DataFrame:
    """Distinct job ids per month of their earliest readable date; observed months only."""
    dated = postings.where("job_id IS NOT NULL AND post_date IS NOT NULL").select(
        "job_id", parse_date(F.col("post_date")).alias("post_date")
    )
    return (
        smallest_per_key(dated.where("post_date IS NOT NULL"), ["job_id"], "post_date")
        .groupBy(month_start(F.col("post_date")).alias("month"))
        .agg(F.count("job_id").alias("posting_count"))
        .orderBy("month")
    )


def monthly_counts_both(postings: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """:func:`monthly_counts` of all and of focal postings, told apart by ``focal``; one pass."""
    day = parse_date(F.col("post_date"))
    per_job = (
        postings.select("job_id", day.alias("day"), F.col("job_category").isin(*categories).alias("_focal"))
        .groupBy("job_id")
        .agg(F.min("day").alias("all"), F.min(F.when(F.col("_focal"), F.col("day"))).alias("own"))
    )
    both = F.array(
        *(
            F.struct(F.lit(focal).alias("focal"), month_start(F.col(name)).alias("month"))
            for focal, name in ((False, "all"), (True, "own"))
        )
    )
    return (
        per_job.select(F.inline(both))
        .where("month IS NOT NULL")
        .groupBy("focal", "month")
        .agg(F.count(F.lit(1)).alias("posting_count"))
    )


def fill_calendar(monthly: DataFrame, calendar: tuple[str, str]) -> DataFrame:
    """Every month of the calendar; months without postings stay null.

    The broadcast is bounded: readable dates span 585 years, thus about 7,000 months.
    """
    months = monthly.sparkSession.range(1).select(F.explode(month_range(*calendar)).alias("month"))
    return months.join(F.broadcast(monthly), "month", "left").orderBy("month")
