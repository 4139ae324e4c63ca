"""All results of one study, written out.

The universe is kept on the executors for the length of the run, and its ids are counted
once. Firm-level and pair-level results feed several outputs, so they are written as
Parquet first and read back; a lost executor costs nothing that is already stored.

Spells and each posting board are scanned once (``passes``): their dates are diagnosed while
the rows that results need go by and are stored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spelltally.config import Study
from spelltally.operators import firms as firm_ops
from spelltally.operators import quality
from spelltally.operators import roles as role_ops
from spelltally.operators import sizes as size_ops
from spelltally.operators.firms import FirmUniverse
from spelltally.plans import extraction, firms, monthly, passes, roles
from spelltally.sources.sinks import kept, write_csv, write_parquet


def run_report(tables, study: Study, folder: str) -> dict[str, StructType]:
    """Write every result as CSV under ``folder``; returns their names and schemas.

    Raises ``ValueError`` when a key, a join or a sum does not hold.
    """
    universe = extraction.universe(tables, study)
    with kept(universe.firms):
        same = FirmUniverse(universe.firms, universe.firms.select("rcid"), universe.extracted)
        return _write_results(tables, study, same, folder)


def _write_results(tables, study: Study, universe: FirmUniverse, folder: str) -> dict[str, StructType]:
    names: dict[str, StructType] = {}

    def stored(name: str, frame: DataFrame) -> DataFrame:
        return write_parquet(frame, f"{folder}/_parquet/{name}")

    def save(name: str, frame: DataFrame) -> None:
        write_csv(frame, f"{folder}/{name}")
        names[name] = frame.schema

    def save_by_country(name: str, members: DataFrame) -> None:
        # Grouped once: what was stored is checked before it becomes a result.
        grouped = stored(name, firm_ops.firms_by_country(members))
        quality.enforce(quality.check_group_sum(grouped, "company_count", members, name))
        save(name, grouped.orderBy(F.desc("company_count"), F.asc("hq_country")))

    quality.enforce(quality.check_key(universe.firms, "rcid", "companies.rcid"))
    save_by_country("companies_by_country", universe.firms)

    spells, dates = passes.spells_pass(tables, study, universe, f"{folder}/_parquet/active_spells")
    kept_rows, posting_dates = {"user_positions": spells}, []
    for board in firms.BOARDS.values():
        kept_rows[board], found = passes.postings_pass(tables, board, universe, f"{folder}/_parquet/{board}")
        posting_dates.append(found)
    tables = passes.PassedTables(kept_rows)
    universe = FirmUniverse(universe.firms, universe.ids, extracted=True)

    both = stored("firm_counts", firms.firm_and_focal_counts(tables, study, universe))
    employees = both.drop("focal_employee_count")
    focal = both.drop("employee_count")
    postings = stored("firm_posting_counts", firms.firm_posting_counts(tables, study, universe))
    sides = ("firm_employee_counts", "firm_posting_counts")
    quality.enforce(quality.check_same_universe(employees, postings, "rcid", sides))
    # The join itself fails on a firm that stands twice.
    active = stored("active_firms", firm_ops.flag_active(firm_ops.join_firm_counts(employees, postings, validate=True)))
    save("firm_employee_counts", employees)
    save("firm_posting_counts", postings)
    save("firm_focal_counts", focal)
    save("active_firms", active)
    save_by_country("employing_by_country", firm_ops.positive(employees, "employee_count"))
    save_by_country("posting_by_country", firm_ops.positive(postings, "posting_count"))
    save_by_country("active_by_country", active.where(F.col("active_firm")))

    for name, counts in (("employee_count", employees), ("focal_employee_count", focal)):
        quality.enforce(quality.check_nonnegative(counts, name, name))
        sizes = stored(f"{name}_sizes", size_ops.size_table(counts, name))
        save(f"{name}_description", size_ops.size_description(sizes, name))
        save(f"{name}_cutoff", size_ops.truncation(sizes, name, study.truncation_quantile))
        save(
            f"{name}_histogram",
            size_ops.truncated_histogram(sizes, name, study.truncation_quantile),
        )

    pairs = stored("pair_summary", roles.pair_summary_by_number(tables, study, universe))
    primary = pairs.select(
        F.col("primary_category").alias("job_category"), F.col("primary_role").alias(study.role)
    )
    composition = stored(
        "role_composition", role_ops.role_composition(primary, study.role, study.all_sample)
    )
    save("role_composition", composition.orderBy("sample", "rank"))
    save("role_concentration", role_ops.role_concentration(composition))
    save("role_selection_diagnostics", role_ops.role_selection_diagnostics(pairs))

    for name, reading in (("positions", passes.STRICT), ("trimmed", passes.TRIMMED)):
        save(f"date_diagnostics_{name}", dates.where(F.col("reading") == reading).drop("reading"))
    save("date_diagnostics_postings", reduce(DataFrame.unionByName, posting_dates))

    for board in firms.BOARDS.values():
        months = stored(f"monthly_{board}", monthly.monthly_postings_both(tables, study, board, universe))
        for name, focal_only in (("monthly", False), ("monthly_focal", True)):
            series = months.where(F.col("focal") == focal_only).drop("focal").orderBy("month")
            save(f"{name}_{board}", series)
    return names
