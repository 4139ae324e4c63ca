"""Extraction of one industry: its companies, their spells and their postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spelltally.config import Study
from spelltally.functions.text import label_or_missing
from spelltally.operators.dedup import one_row_per_key
from spelltally.operators.firms import FirmUniverse, in_industries
from spelltally.sources.sinks import export_dataframe

FACTS = ("user_positions", "postings_linkedin", "postings_indeed")


def companies(tables, study: Study) -> DataFrame:
    """All columns of the industry's companies, one row per company."""
    return one_row_per_key(
        in_industries(tables.frame("company_ref"), study.industries), "rcid", lead="hq_country"
    )


def universe(tables, study: Study) -> FirmUniverse:
    """Firm ids with a cleaned country; reads three columns of the company table."""
    named = in_industries(
        tables.frame("company_ref", "rcid", "hq_country", "rics_k400"), study.industries
    ).select("rcid", "hq_country")
    firms = one_row_per_key(named, "rcid", lead="hq_country").select(
        "rcid", label_or_missing(F.col("hq_country")).alias("hq_country")
    )
    ids = in_industries(tables.frame("company_ref", "rcid", "rics_k400"), study.industries)
    return FirmUniverse(firms, ids.select("rcid"), getattr(tables, "extracted", False))


def focal_facts(tables, study: Study, name: str) -> DataFrame:
    """Rows of a fact table that belong to the industry's companies, columns unchanged."""
    return universe(tables, study).keep(tables.frame(name))


def extract_summary(tables, study: Study) -> DataFrame:
    """Row count of each extract."""
    firms = universe(tables, study)
    summary = firms.firms.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit("companies").alias("extract"), "row_count"
    )
    for name in FACTS:
        rows = firms.keep(tables.frame(name, "rcid")).agg(F.count(F.lit(1)).alias("row_count"))
        summary = summary.unionByName(rows.select(F.lit(name).alias("extract"), "row_count"))
    return summary


def company_total(tables, study: Study) -> DataFrame:
    return (
        in_industries(tables.frame("company_ref", "rcid", "rics_k400"), study.industries)
        .agg(F.count_distinct("rcid").alias("company_total"))
    )


def run_extraction(
    tables, study: Study, folder: str, fmt: str = "parquet", prefix: str | None = None
) -> dict[str, DataFrame]:
    """Write the four extracts, each as a table and as Parquet; returns what was written.

    Table names begin with ``prefix``, which may name a database, or with the study's name.
    The company extract serves all three semi-joins from the stored copy.
    """
    prefix = f"{study.name}_" if prefix is None else prefix

    def export(name: str, frame: DataFrame) -> DataFrame:
        return export_dataframe(frame, f"{prefix}{name}", f"{folder}/{name}", fmt=fmt)

    written = {"company_ref": export("company_ref", companies(tables, study))}
    stored = written["company_ref"]
    firms = FirmUniverse(stored.select("rcid", "hq_country"), stored.select("rcid"))
    for name in FACTS:
        written[name] = export(name, firms.keep(tables.frame(name)))
    return written
