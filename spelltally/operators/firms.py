"""The company universe, and facts restricted to it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spelltally.functions.numbers import zero_if_null

# A broadcast of firm ids is used up to this many rows: one long each, tens of MB in all.
BROADCAST_FIRMS = 1_000_000


def in_industries(company_ref: DataFrame, industries: tuple[str, ...]) -> DataFrame:
    return company_ref.where(F.col("rics_k400").isin(*industries))


@dataclass
class FirmUniverse:
    """Firms of interest.

    ``firms`` holds one row per ``rcid`` with the country; ``ids`` holds the ids alone,
    where repeats do no harm. ``extracted`` says that the fact tables hold these firms
    only, so that no join is needed to restrict them.
    """

    firms: DataFrame
    ids: DataFrame
    extracted: bool = False
    broadcast_rows: int = BROADCAST_FIRMS

    @cached_property
    def small(self) -> bool:
        """Whether the ids may be broadcast; costs one count of the filtered company table."""
        return self.ids.count() <= self.broadcast_rows

    def keep(self, facts: DataFrame) -> DataFrame:
        """Facts of these firms; a semi-join, so no row multiplies and no column is added.

        Few ids go out as a broadcast and the facts are not shuffled. Many ids are
        joined by shuffle, where adaptive execution splits the partition of a hot firm.
        It does so only if both sides come straight from a shuffle, hence plain ids
        without a distinct on top. There the session's settings let the optimizer build a
        Bloom filter of the ids, which drops most other facts before the shuffle.
        """
        if self.extracted:
            return facts
        ids = F.broadcast(self.ids) if self.small else self.ids
        return facts.join(ids, "rcid", "left_semi").select(*facts.columns)

    def keep_if_cheap(self, facts: DataFrame) -> DataFrame:
        """:meth:`keep` where it needs no shuffle, for facts that meet the firms later anyway."""
        return self.keep(facts) if self.extracted or self.small else facts

    def keep_grouped(
        self, facts: DataFrame, group: Callable[[DataFrame], DataFrame]
    ) -> DataFrame:
        """``group(keep(facts))`` for a grouping that has ``rcid`` among its keys.

        With many ids the facts are grouped first: grouping after a shuffle join on
        ``rcid`` would reuse its partitioning and leave a hot firm in one task.
        """
        if self.extracted or self.small:
            return group(self.keep(facts))
        return self.keep(group(facts))

    def with_counts(self, counts: DataFrame, name: str, validate: bool = False) -> DataFrame:
        """All firms with their count; firms without one get zero. ``validate`` as in ``join_firm_counts``."""
        firms = self.firms
        if validate:
            firms, counts = once(firms, "rcid", "firms"), once(counts, "rcid", name)
        return firms.join(counts, "rcid", "left").select(
            "rcid", "hq_country", zero_if_null(F.col(name)).alias(name)
        )


def once(frame: DataFrame, key: str, subject: str) -> DataFrame:
    """The frame; the job that uses it fails on a key that stands in more than one row.

    The count goes over the key's partition of the join that follows, so it adds no shuffle to one.
    For results with one row per key, or nearly so: rows of one key meet in a task.
    """
    repeated = F.count(F.lit(1)).over(Window.partitionBy(key)) > 1
    message = F.concat(F.lit(f"one_to_one of {subject}: {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(" is repeated"))
    checked = F.when(F.col("_repeated"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return frame.withColumn("_repeated", repeated).where(checked).drop("_repeated")


def join_firm_counts(left: DataFrame, right: DataFrame, validate: bool = False) -> DataFrame:
    """Two firm-level results side by side, one row per firm in both.

    With ``validate`` the join itself fails when a side holds a firm twice.
    """
    if validate:
        left, right = once(left, "rcid", "left"), once(right, "rcid", "right")
    return left.join(right.drop("hq_country"), "rcid", "inner")


def flag_active(counts: DataFrame) -> DataFrame:
    """A firm is active with at least one employee and at least one posting."""
    return counts.withColumn(
        "active_firm", (F.col("employee_count") > 0) & (F.col("posting_count") > 0)
    )


def positive(counts: DataFrame, name: str) -> DataFrame:
    return counts.where(F.col(name) > 0)


def firms_by_country(firms: DataFrame) -> DataFrame:
    """Companies per country, largest first, ties by name. ``rcid`` is unique by contract."""
    return (
        firms.groupBy("hq_country")
        .agg(F.count("rcid").alias("company_count"))
        .orderBy(F.desc("company_count"), F.asc("hq_country"))
    )


def largest(by_country: DataFrame, number: int) -> DataFrame:
    """The largest groups, put in rising order for display."""
    return (
        by_country.orderBy(F.desc("company_count"), F.asc("hq_country"))
        .limit(number)
        .orderBy(F.asc("company_count"), F.desc("hq_country"))
    )
