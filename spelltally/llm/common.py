"""What the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spelltally.sources.scratch import scratch_path

# Words are runs of anything but ASCII white space. Python's bytes.split() cuts alike.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Write rows once to the shared scratch folder and go on from there.

    Later steps neither repeat the work nor depend on an executor that made it.
    """
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Named columns of a provided table."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def quoted(name: str) -> Column:
    """A column whose name may hold dots or back ticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(text: str | Column = "text") -> Column:
    """A text, with null as the empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``. A null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def without(frame: DataFrame, *names: str) -> DataFrame:
    """The frame without columns whose names a result is about to take."""
    taken = {name.lower() for name in names}
    return frame.select(*(quoted(c) for c in frame.columns if c.lower() not in taken))


def whole_nodes(batches: Iterator[pd.DataFrame], key: str = "node") -> Iterator[pd.DataFrame]:
    """Rows sorted by node, in frames that hold whole nodes."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        rest.append(batch)
        last = batch[key].iloc[-1]
        if last == rest[0][key].iloc[0]:
            continue
        rows = pd.concat(rest, ignore_index=True)
        cut = int((rows[key].to_numpy() != last).sum())
        yield rows.iloc[:cut].reset_index(drop=True)
        rest = [rows.iloc[cut:]]
    if rest:
        yield pd.concat(rest, ignore_index=True)


def node_starts(node: np.ndarray) -> np.ndarray:
    """Where each node starts, and the end."""
    return np.r_[np.flatnonzero(np.r_[True, node[1:] != node[:-1]]), len(node)]
