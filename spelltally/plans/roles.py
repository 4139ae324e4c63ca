"""Detailed-role composition of focal employees at the snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spelltally.config import Study
from spelltally.functions.text import label_or_missing
from spelltally.operators import roles as role_ops
from spelltally.operators import spells as spell_ops
from spelltally.operators.firms import FirmUniverse
from spelltally.plans.extraction import universe


def _per_pair(
    tables,
    study: Study,
    group: Callable[[DataFrame, str], DataFrame],
    firms: FirmUniverse | None = None,
) -> DataFrame:
    """Group the focal active spells of the study's firms by user and firm."""
    positions = tables.frame(
        "user_positions", "rcid", "user_id", "startdate", "enddate", "job_category", study.role
    )

    def grouped(rows: DataFrame) -> DataFrame:
        spells = spell_ops.role_spells(rows, study.snapshot, study.categories, study.role)
        return group(spells, study.role)

    return (firms or universe(tables, study)).keep_grouped(positions, grouped)


def _dictionary(tables, study: Study) -> DataFrame | None:
    # Each spelling is cleaned once, not once per spell.
    spellings = tables.frame("user_positions", study.role).distinct()
    names = spellings.select(label_or_missing(F.col(study.role)).alias(study.role))
    return spell_ops.role_dictionary(names, study.role)


def primary_roles(tables, study: Study) -> DataFrame:
    return _per_pair(tables, study, spell_ops.primary_spells)


def primary_roles_by_number(tables, study: Study) -> DataFrame:
    """:func:`primary_roles` by role codes; one more scan of the roles, and no sort."""
    codes = _dictionary(tables, study)
    if codes is None:
        return primary_roles(tables, study)
    return _per_pair(
        tables, study, lambda rows, role: spell_ops.primary_spells_by_number(rows, role, study.categories, codes)
    )


def pair_summary_by_number(tables, study: Study, firms: FirmUniverse | None = None) -> DataFrame:
    """:func:`pair_summary` by role codes."""
    codes = _dictionary(tables, study)
    if codes is None:
        return pair_summary(tables, study, firms)
    return _per_pair(
        tables, study, lambda rows, role: spell_ops.pair_summary_by_number(rows, role, study.categories, codes), firms
    )


def overlap_counts(tables, study: Study) -> DataFrame:
    return _per_pair(
        tables, study, lambda rows, role: spell_ops.overlap_counts(rows, role, study.categories)
    )


def pair_summary(tables, study: Study, firms: FirmUniverse | None = None) -> DataFrame:
    """What composition and diagnostics need to know of each pair."""
    return _per_pair(tables, study, spell_ops.pair_summary, firms)


def role_selection_diagnostics(tables, study: Study) -> DataFrame:
    return role_ops.role_selection_diagnostics(pair_summary(tables, study))


def role_composition(tables, study: Study) -> DataFrame:
    return role_ops.role_composition(primary_roles(tables, study), study.role, study.all_sample)


def role_concentration(tables, study: Study) -> DataFrame:
    return role_ops.role_concentration(role_composition(tables, study))


def top_roles_overall(tables, study: Study) -> DataFrame:
    return role_ops.top_roles_overall(
        role_composition(tables, study), study.all_sample, study.top_roles
    )


def top_roles_by_category(tables, study: Study) -> DataFrame:
    return role_ops.top_roles_by_category(
        role_composition(tables, study), study.categories, study.top_roles_per_category
    )
