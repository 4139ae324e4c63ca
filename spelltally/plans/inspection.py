"""A first look at a source table: its universes, a sample and a profile."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spelltally.operators import samples
from spelltally.operators.dedup import observed_combinations
from spelltally.operators.quality import profile_table
from spelltally.schemas import RANDOMLY_SAMPLED, SOURCE_TABLES, UNIVERSES
from spelltally.sources.sinks import export_dataframe


def universes(tables, name: str) -> dict[str, DataFrame]:
    """Observed combinations of the table's category levels, by subject."""
    return {
        subject: observed_combinations(tables.frame(name, *levels), *levels)
        for subject, levels in UNIVERSES.get(name, {}).items()
    }


def sample(tables, name: str, number: int = 1000, seed: int = 2022) -> DataFrame:
    """Rows to look at, validated columns only."""
    table = SOURCE_TABLES[name].project(tables.frame(name))
    if name in RANDOMLY_SAMPLED:
        return samples.hashed_rows(table, number, seed, SOURCE_TABLES[name].key)
    return samples.first_rows(table, number)


def profile(tables, name: str) -> DataFrame:
    """Types, nulls and the declared key over the whole table."""
    source = SOURCE_TABLES[name]
    return profile_table(source.project(tables.frame(name)), name, source.key)


def run_inspection(tables, name: str, folder: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Write the universes, the sample and the profile as tables and as Parquet."""
    results = {f"universe_{subject}": frame for subject, frame in universes(tables, name).items()}
    results |= {"sample": sample(tables, name), "profile": profile(tables, name)}
    return {
        label: export_dataframe(
            frame, f"{name}_{label}", f"{folder}/{name}_{label}", single_part=True, fmt=fmt
        )
        for label, frame in results.items()
    }
