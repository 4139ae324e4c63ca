"""Samples of a fixed number of rows, for looking at a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_rows(frame: DataFrame, number: int) -> DataFrame:
    """Any rows, as fast as possible."""
    return frame.limit(number)


def _digest(columns: list[str], seed: int) -> Column:
    """A digest of some columns, each with its length and nulls marked."""
    text = []
    for name in columns:
        value = F.col(name).cast("string")
        text.append(F.coalesce(F.concat(F.lit("+"), F.length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.md5(F.concat_ws("|", *text, F.lit(str(seed))))


def hashed_rows(frame: DataFrame, number: int, seed: int, key: tuple[str, ...] = ()) -> DataFrame:
    """A seeded draw that any engine repeats: the rows with the smallest digest of their key.

    Rows of one key are told apart by a digest of all columns, so only identical rows can tie;
    without ``key`` all columns are one. Of a large table only rows below a bound on the digest
    are ranked, set from the row count so that some more than ``number`` stay. If fewer do, as
    when few keys have most of the rows, all rows are ranked.
    """
    by_key = _digest(list(key or frame.columns), seed)
    rows = frame.count()
    wanted = number + 8 * number**0.5 + 64
    if 4 * wanted < rows:
        near = frame.where(F.substring(by_key, 1, 8) <= f"{int(wanted / rows * 2**32):08x}")
        if near.limit(number).count() == number:
            frame = near
    return frame.orderBy(by_key, _digest(frame.columns, seed)).limit(number)
