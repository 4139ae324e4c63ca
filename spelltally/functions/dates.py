"""Strict date parsing, activity at a date, and calendar months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spelltally.functions.text import SPACE, has_text

# Year-month-day text, one or two digits for month and day, from 1677-09-22
# to 2262-04-11, the range of a 64-bit nanosecond timestamp.
DAY = "[0-9]{1,2}"
WHOLE_YEARS = "1[789][0-9]{2}|2[01][0-9]{2}|22[0-5][0-9]|226[01]|16[89][0-9]|167[89]"
READABLE = "|".join(
    (
        f"(?:{WHOLE_YEARS})-{DAY}-{DAY}",
        f"1677-(?:0?9-(?:2[2-9]|30)|1[0-2]-{DAY})",
        f"2262-(?:0?[1-3]-{DAY}|0?4-(?:0?[1-9]|1[01]))",
    )
)


def parse_date(text: Column) -> Column:
    """Year-month-day text to a date; anything else, or out of range, becomes null.

    One pattern decides on shape and range; text that does not fit gives an empty
    extract, which the cast turns into null.
    """
    return F.regexp_extract(text, rf"^({READABLE})\z", 1).try_cast("date")


def parse_date_trimmed(text: Column) -> Column:
    """As :func:`parse_date`, with white space at both ends allowed."""
    return F.regexp_extract(text, rf"^[{SPACE}]*({READABLE})[{SPACE}]*\z", 1).try_cast("date")


def after_year(day: str) -> str:
    """Text that sorts after every strict date of the day's year, and before the next year's."""
    return f"{int(day[:4]) + 1:04d}"


def active_at(
    start_text: Column, end_text: Column, snapshot: str, parse=parse_date
) -> Column:
    """Spell is running on the snapshot date.

    No end date means still running; an end date which cannot be read does not. The
    cheap tests come first, and a spell without an end is told before any pattern runs.
    A strict date begins with its year, so the order of texts bounds it, and Parquet
    readers can skip by that; padding would break the order.
    """
    running = running_at(parse(start_text), parse(end_text), end_text, snapshot)
    if parse is parse_date:
        return (start_text < after_year(snapshot)) & running
    return running


def running_at(start: Column, end: Column, end_text: Column, snapshot: str) -> Column:
    """:func:`active_at` of dates that are read already."""
    day = F.lit(snapshot).cast("date")
    return (start <= day) & (end_text.isNull() | (end >= day) | ~has_text(end_text))


def in_period(day: Column, period: tuple[str, str]) -> Column:
    first, last = period
    return day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def dated_within(text: Column, period: tuple[str, str]) -> Column:
    """Strict date text within a period. The years bound the text itself, as in :func:`active_at`."""
    first, last = period
    years = (text >= first[:4]) & (text < after_year(last))
    return years & in_period(parse_date(text), period)


def month_start(day: Column) -> Column:
    """First day of the month, kept as a date."""
    return F.trunc(day, "month")


def month_range(first: str, last: str) -> Column:
    """Array of all month starts from first to last, both included."""
    return F.sequence(
        F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month")
    )
