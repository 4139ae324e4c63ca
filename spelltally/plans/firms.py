"""Counts per firm, active firms, and firms by country."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spelltally.config import Study
from spelltally.functions.numbers import zero_if_null
from spelltally.operators import bitmaps
from spelltally.operators import firms as firm_ops
from spelltally.operators import postings as posting_ops
from spelltally.operators import spells as spell_ops
from spelltally.operators.dedup import distinct_pairs
from spelltally.operators.firms import FirmUniverse
from spelltally.plans.extraction import universe

SPELL_DATES = ("rcid", "user_id", "startdate", "enddate")
BOARDS = {"LinkedIn": "postings_linkedin", "Indeed": "postings_indeed"}


def active_user_firms(tables, study: Study) -> DataFrame:
    """Distinct user-firm pairs with a spell running at the snapshot."""

    def pairs(positions: DataFrame) -> DataFrame:
        return distinct_pairs(spell_ops.active_spells(positions, study.snapshot), "rcid", "user_id")

    return universe(tables, study).keep_grouped(
        tables.frame("user_positions", *SPELL_DATES), pairs
    )


def _employees(spells: DataFrame, firms: FirmUniverse, name: str) -> DataFrame:
    pairs = distinct_pairs(firms.keep_if_cheap(spells), "rcid", "user_id")
    return firms.with_counts(spell_ops.users_per_firm(pairs, name), name)


def firm_employee_counts(tables, study: Study, firms: FirmUniverse | None = None) -> DataFrame:
    positions = tables.frame("user_positions", *SPELL_DATES)
    return _employees(
        spell_ops.active_spells(positions, study.snapshot),
        firms or universe(tables, study),
        "employee_count",
    )


def firm_focal_counts(tables, study: Study, firms: FirmUniverse | None = None) -> DataFrame:
    positions = tables.frame("user_positions", *SPELL_DATES, "job_category")
    return _employees(
        spell_ops.focal_active_spells(positions, study.snapshot, study.categories),
        firms or universe(tables, study),
        "focal_employee_count",
    )


def firm_and_focal_counts(tables, study: Study, firms: FirmUniverse) -> DataFrame:
    """Both counts of employees per firm from one pass over the spells."""
    positions = tables.frame("user_positions", *SPELL_DATES, "job_category")
    active = spell_ops.active_spells(positions, study.snapshot)
    counts = spell_ops.users_and_focal_users_per_firm(firms.keep_if_cheap(active), study.categories)
    names = ("employee_count", "focal_employee_count")
    return firms.firms.join(counts, "rcid", "left").select(
        "rcid", "hq_country", *(zero_if_null(F.col(name)).alias(name) for name in names)
    )


def employee_state(tables, study: Study, firms: FirmUniverse | None = None) -> DataFrame:
    """Employees at the snapshot as mergeable bitmaps, one word per firm, country and bucket of ids."""
    firms = firms or universe(tables, study)
    positions = tables.frame("user_positions", *SPELL_DATES)

    def state(rows: DataFrame) -> DataFrame:
        return bitmaps.bitmap_state(spell_ops.active_spells(rows, study.snapshot), ("rcid",), "user_id")

    return firms.keep_grouped(positions, state).join(firms.firms, "rcid")


def employees_by_level(state: DataFrame) -> DataFrame:
    """Distinct employees per firm, per country and over all, from one stored ``employee_state``.

    Somebody employed by two firms counts once in each, and once in their country.
    """
    levels = (("firm", ("hq_country", "rcid")), ("country", ("hq_country",)), ("all", ()))
    rows = []
    for level, group in levels:
        counts = bitmaps.id_counts(state, "employee_count", *group)
        missing = [F.lit(None).cast(state.schema[name].dataType).alias(name) for name in ("hq_country", "rcid") if name not in group]
        rows.append(counts.select(F.lit(level).alias("level"), "employee_count", *group, *missing))
    return reduce(DataFrame.unionByName, rows).select("level", "hq_country", "rcid", "employee_count")


def posting_keys(tables, study: Study, firms: FirmUniverse | None = None) -> DataFrame:
    sources = {
        board: tables.frame(name, "rcid", "job_id", "post_date") for board, name in BOARDS.items()
    }
    return posting_ops.posting_keys(sources, firms or universe(tables, study), study.period)


def firm_posting_counts(tables, study: Study, firms: FirmUniverse | None = None) -> DataFrame:
    firms = firms or universe(tables, study)
    counts = posting_ops.postings_per_firm(posting_keys(tables, study, firms))
    return firms.with_counts(counts, "posting_count")


def active_firms(tables, study: Study) -> DataFrame:
    firms = universe(tables, study)
    return firm_ops.flag_active(
        firm_ops.join_firm_counts(
            firm_employee_counts(tables, study, firms), firm_posting_counts(tables, study, firms)
        )
    )


def companies_by_country(tables, study: Study) -> DataFrame:
    return firm_ops.firms_by_country(universe(tables, study).firms)


def employing_by_country(tables, study: Study) -> DataFrame:
    return firm_ops.firms_by_country(
        firm_ops.positive(firm_employee_counts(tables, study), "employee_count")
    )


def posting_by_country(tables, study: Study) -> DataFrame:
    return firm_ops.firms_by_country(
        firm_ops.positive(firm_posting_counts(tables, study), "posting_count")
    )


def active_by_country(tables, study: Study) -> DataFrame:
    return firm_ops.firms_by_country(active_firms(tables, study).where(F.col("active_firm")))


def top_countries(tables, study: Study) -> DataFrame:
    return firm_ops.largest(companies_by_country(tables, study), study.top_countries)
