"""Distinct counts of whole-number ids by mergeable bitmaps.

An id is a bit in one of the words that cut the number line into pieces of 64. What is
stored is one word per group and piece that has an id; words of several groups merge by OR, so
the same state answers for a firm, a country and over all, exactly, without the ids. A group
with many ids spreads over many words, so no task holds more than one word of it at a time.

A word is a number, so aggregates hash rather than sort, and a row is as small where ids lie
far apart as where they lie close together: never more rows than distinct ids per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET, BITS = "id_bucket", "id_bits"
# 64 ids to a word.
WORD_BITS = 6


def bitmap_state(rows: DataFrame, group: tuple[str, ...], name: str) -> DataFrame:
    """One word of bits of the ids in ``name`` per group and bucket; null ids are left out."""
    known = rows.where(F.col(name).isNotNull()).select(*group, F.col(name).cast("long").alias("_id"))
    place = F.col("_id").bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int")
    return (
        known.withColumn(BUCKET, F.shiftright("_id", WORD_BITS))
        .groupBy(*group, BUCKET)
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias(BITS))
    )


def merged(state: DataFrame, *group: str) -> DataFrame:
    """The state of coarser groups."""
    return state.groupBy(*group, BUCKET).agg(F.bit_or(BITS).alias(BITS))


def id_counts(state: DataFrame, name: str, *group: str) -> DataFrame:
    """Distinct ids per group, without a group over all."""
    counts = merged(state, *group).select(*group, F.bit_count(BITS).alias("_n"))
    return counts.groupBy(*group).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias(name))
