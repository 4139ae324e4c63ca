"""Monthly posting series per board, for all and for focal postings."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spelltally.config import Study
from spelltally.operators import postings as posting_ops
from spelltally.operators.firms import FirmUniverse
from spelltally.operators.spells import of_categories
from spelltally.plans.extraction import universe


def monthly_postings(tables, study: Study, board: str, focal: bool = False) -> DataFrame:
    """Observed months only."""
    columns = ("rcid", "job_id", "post_date") + (("job_category",) if focal else ())
    postings = tables.frame(board, *columns).where("job_id IS NOT NULL")
    if focal:
        postings = of_categories(postings, study.categories)
    return posting_ops.monthly_counts(universe(tables, study).keep(postings))


def monthly_postings_both(tables, study: Study, board: str, firms: FirmUniverse) -> DataFrame:
    """The series of all and of focal postings, told apart by ``focal``; one pass."""
    postings = tables.frame(board, "rcid", "job_id", "post_date", "job_category").where("job_id IS NOT NULL")
    return posting_ops.monthly_counts_both(firms.keep(postings), study.categories)


def monthly_series(tables, study: Study, board: str, focal: bool = False) -> DataFrame:
    """All calendar months, with gaps left null."""
    return posting_ops.fill_calendar(
        monthly_postings(tables, study, board, focal), study.calendar
    )
