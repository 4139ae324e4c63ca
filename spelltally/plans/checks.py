"""Data-quality reports of a study."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spelltally.config import Study
from spelltally.functions.dates import parse_date, parse_date_trimmed
from spelltally.operators import quality
from spelltally.plans import firms as firm_plans
from spelltally.plans.extraction import companies, universe
from spelltally.schemas import SOURCE_TABLES


def position_dates(tables, study: Study, trimmed: bool = False) -> DataFrame:
    """How the spell dates of the study's firms convert."""
    positions = universe(tables, study).keep(
        tables.frame("user_positions", "rcid", "startdate", "enddate")
    )
    return quality.date_diagnostics(
        positions,
        "user_positions",
        "startdate",
        "enddate",
        parse=parse_date_trimmed if trimmed else parse_date,
    )


def posting_dates(tables, study: Study) -> DataFrame:
    """How the posting dates of the study's firms convert, per board."""
    firms = universe(tables, study)
    return reduce(
        DataFrame.unionByName,
        [
            quality.date_diagnostics(
                firms.keep(tables.frame(name, "rcid", "post_date")), name, "post_date"
            )
            for name in firm_plans.BOARDS.values()
        ],
    )


def date_report(tables, study: Study) -> DataFrame:
    return quality.date_report(position_dates(tables, study))


def declared_keys(tables, study: Study, *names: str) -> DataFrame:
    """The declared key of each source table, over the whole table."""
    return reduce(
        DataFrame.unionByName,
        [
            quality.check_key(
                tables.frame(name, *SOURCE_TABLES[name].key),
                SOURCE_TABLES[name].key,
                f"{name}.{' + '.join(SOURCE_TABLES[name].key)}",
            )
            for name in names
        ],
    )


def nonnegative_counts(tables, study: Study) -> DataFrame:
    return quality.check_nonnegative(
        firm_plans.firm_employee_counts(tables, study), "employee_count", "employee_count"
    )


def firm_join(tables, study: Study) -> DataFrame:
    """Companies join spells one to one: the companies hold each firm once, the spells don't."""
    return quality.check_one_to_one(
        companies(tables, study).select("rcid"),
        tables.frame("user_positions", "rcid"),
        "rcid",
        ("companies", "user_positions"),
    )


def same_firms(tables, study: Study) -> DataFrame:
    """The study's companies and the firms with postings are the same; each side lacks some."""
    return quality.check_same_universe(
        companies(tables, study).select("rcid"),
        tables.frame("postings_indeed", "rcid"),
        "rcid",
        ("companies", "postings_indeed"),
    )


def country_sums(tables, study: Study) -> DataFrame:
    """Country counts add up to the firms they were made from, for all four groupings."""
    return quality.check_group_sums(
        firm_plans.active_firms(tables, study),
        "rcid",
        "hq_country",
        {
            "companies_by_country": F.lit(True),
            "employing_by_country": F.col("employee_count") > 0,
            "posting_by_country": F.col("posting_count") > 0,
            "active_by_country": F.col("active_firm"),
        },
    )


def profiles(tables, study: Study, *names: str) -> DataFrame:
    """Profile of each named source table, over the whole table."""
    return reduce(
        DataFrame.unionByName,
        [
            quality.profile_table(tables.frame(name), name, SOURCE_TABLES[name].key)
            for name in names
        ],
    )
