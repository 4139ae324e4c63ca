"""One pass over each fact table: what a report needs is kept, dates are diagnosed on the way.

A pass restricts the facts to the study's firms, counts its date figures while they go by,
drops what no result uses and writes the rest, a few columns, as Parquet. All that follows
reads the written rows. The write is the last stage of its job, so the figures hold even when
an executor is lost in the middle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spelltally.config import Study
from spelltally.functions.dates import parse_date, parse_date_trimmed
from spelltally.operators import quality
from spelltally.operators import spells as spell_ops
from spelltally.operators.firms import FirmUniverse
from spelltally.sources.sinks import write_parquet

STRICT, TRIMMED = "strict", "trimmed"
READINGS = {STRICT: parse_date, TRIMMED: parse_date_trimmed}


@dataclass(frozen=True)
class PassedTables:
    """Rows that a pass has kept, as tables of the study's firms only."""

    frames: dict[str, DataFrame]
    extracted: bool = True

    def frame(self, name: str, *columns: str) -> DataFrame:
        return self.frames[name].select(*columns) if columns else self.frames[name]


def read_as(variable: str, reading: str) -> str:
    return f"_{variable}_{reading}"


def with_dates(facts: DataFrame, *variables: str, trimmed: bool = False) -> DataFrame:
    """Facts with their dates parsed once, for the figures and for what is kept.

    A text that reads strictly reads the same when trimmed, so the second pattern runs on the rest only.
    """
    read = facts.select("*", *(parse_date(F.col(name)).alias(read_as(name, STRICT)) for name in variables))
    if not trimmed:
        return read
    return read.select(
        "*",
        *(F.coalesce(read_as(name, STRICT), parse_date_trimmed(F.col(name))).alias(read_as(name, TRIMMED)) for name in variables),
    )


def spells_pass(tables, study: Study, firms: FirmUniverse, path: str) -> tuple[DataFrame, DataFrame]:
    """Spells running at the snapshot, and the date diagnostics of all spells by ``reading``.

    Dates are trimmed before a spell is dropped: one that runs by its strict dates runs by the
    trimmed ones as well.
    """
    columns = ("rcid", "user_id", "startdate", "enddate", "job_category", study.role)
    facts = firms.keep(tables.frame("user_positions", *columns))
    read = with_dates(facts, "startdate", "enddate", trimmed=True)
    watched, dates = quality.dates_in_passing(
        read, "user_positions", "startdate", "enddate", readings=READINGS, read=read_as
    )
    by = tuple(read_as(name, TRIMMED) for name in ("startdate", "enddate"))
    running = spell_ops.active_spells(watched, study.snapshot, parse_date_trimmed, by)
    kept = write_parquet(running.select(*columns), path)
    return kept, dates()


def postings_pass(tables, board: str, firms: FirmUniverse, path: str) -> tuple[DataFrame, DataFrame]:
    """Postings of a board with a job id and a readable date, and the date diagnostics of all."""
    columns = ("rcid", "job_id", "post_date", "job_category")
    facts = with_dates(firms.keep(tables.frame(board, *columns)), "post_date")
    day = read_as("post_date", STRICT)
    watched, dates = quality.dates_in_passing(
        facts, board, "post_date", readings={"": parse_date}, read=lambda *_: day
    )
    dated = F.col("job_id").isNotNull() & F.col(day).isNotNull()
    return write_parquet(watched.where(dated).select(*columns), path), dates().drop("reading")
