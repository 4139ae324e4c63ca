"""Shards and slots from a Feistel permutation of global row numbers.

Rows are numbered 0 to n - 1, a keyed Feistel network permutes the numbers, and the
permuted number p puts a row into shard p mod s, slot p div s. Shard sizes differ by one
row at most, slots have no gaps, and ``row_at`` finds the number that fills a slot
without looking at any row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spelltally.llm.common import quoted, without

ROUNDS = 6
SEED = 20240229


def _mixed(values: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mixer (multiply and shift), keyed."""
    x = values + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    rounds = np.arange(1, ROUNDS + 1, dtype=np.uint64)
    return [int(k) for k in _mixed(rounds * np.uint64(0x9E3779B97F4A7C15), seed % 2**64)]


def permute(values: np.ndarray, total: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """Permute numbers of [0, total); ``inverse`` undoes it.

    The network works on the next even number of bits. A number that leaves the range
    walks on along its cycle until it is back; the range holds a quarter of the domain at
    least, so that takes few steps.
    """
    half = np.uint64(max(1, (max(total - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _keys(seed)
    out = np.array(values, dtype=np.uint64)
    pending = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(pending):
            left, right = out[pending] >> half, out[pending] & mask
            for key in reversed(keys) if inverse else keys:
                if inverse:
                    left, right = right ^ (_mixed(left, key) & mask), left
                else:
                    left, right = right, left ^ (_mixed(right, key) & mask)
            out[pending] = (left << half) | right
            pending = pending[out[pending] >= np.uint64(total)]
    return out.astype(np.int64)


def row_at(shard: int, slot: int, shards: int, total: int, seed: int = SEED) -> int:
    """The global row number in a slot of a shard."""
    position = slot * shards + shard
    if not (0 <= shard < shards and 0 <= position < total):
        raise ValueError("no such slot")
    return int(permute(np.array([position]), total, seed, inverse=True)[0])


def numbered(rows: DataFrame, buckets: int = 1024, copies_at_once: int = 10_000) -> DataFrame:
    """Add ``row_number`` (0 to n - 1) and ``row_total``.

    Order: a hash bucket of all columns, then their hash, then the columns, so reruns and
    other partitionings give the same numbers. Repeated rows are counted first and dealt
    out in portions, so no bucket fills up with copies of one row. One row per bucket is
    all that meets in one task or is broadcast. Columns must be groupable (no maps).
    Columns named like a result are replaced; an empty input gives an empty result.
    """
    rows = without(rows, "row_number", "row_total")
    columns = [quoted(name) for name in rows.columns]
    portions = (
        rows.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn(
            "_portion",
            F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / copies_at_once).cast("int"))),
        )
        .withColumn(
            "_copies",
            F.least(F.lit(copies_at_once), F.col("_copies") - F.col("_portion") * copies_at_once),
        )
        .withColumn("_hash", F.xxhash64(F.lit(SEED), *columns, "_portion"))
        .withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    )
    sizes = portions.groupBy("_bucket").agg(F.sum("_copies").alias("_rows"))
    one = Window.partitionBy(F.lit(0))
    offsets = sizes.select(
        "_bucket",
        (F.sum("_rows").over(one.orderBy("_bucket")) - F.col("_rows")).alias("_offset"),
        F.sum("_rows").over(one).alias("row_total"),
    )
    before = (
        Window.partitionBy("_bucket")
        .orderBy("_hash", "_portion", *columns)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        portions.withColumn("_start", F.coalesce(F.sum("_copies").over(before), F.lit(0)))
        .join(F.broadcast(offsets), "_bucket")
        .select(
            *columns,
            (F.col("_offset") + F.col("_start")).alias("_start"),
            "row_total",
            F.explode(F.sequence(F.lit(0), (F.col("_copies") - 1).cast("int"))).alias("_copy"),
        )
        .select(*columns, (F.col("_start") + F.col("_copy")).alias("row_number"), "row_total")
    )


def shard(rows: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Add ``row_number``, ``row_total``, ``shard`` (int) and ``slot`` (long) to each row.

    Nulls, empty and long texts and repeated rows are rows like any other; repeated rows
    get numbers of their own. Columns named like a result are replaced. An empty input
    gives an empty result.
    """

    @F.pandas_udf("long")
    def permuted(number: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), int(total.iloc[0]), seed) if len(number) else number)

    return (
        numbered(without(rows, "shard", "slot"))
        .withColumn("_position", permuted("row_number", "row_total"))
        .withColumn("shard", (F.col("_position") % shards).cast("int"))
        .withColumn("slot", F.floor(F.col("_position") / shards).cast("long"))
        .drop("_position")
    )
