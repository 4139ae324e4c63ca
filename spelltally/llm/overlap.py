"""Links between texts whose sets of shingles overlap, found in nodes of likely partners.

A search deals texts out to nodes. What is here measures nodes without gathering them, keeps
those that could link something new, splits the large ones, and confirms links on full sets.
A node answers with links that span what belongs together, never with all its pairs, so a
mass of near copies makes as many rows as it has members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spelltally.llm.common import node_starts, stored, whole, whole_nodes
from spelltally.llm.simhash import mixed, shingle_hashes

# Rows of a node up to which its texts are compared with each other.
LIMIT = 1024
# Texts are looked up by id and hashes after a first cut by this many buckets, which bounds what is sent out.
LOOKUP_BUCKETS = 1 << 20
SEED = 42


def text_keys(docs: DataFrame) -> DataFrame:
    """doc_id, two hashes of id and text that find a row again, and the text (null: empty)."""
    return docs.select(
        "doc_id",
        F.xxhash64("doc_id", whole()).alias("key1"),
        F.xxhash64(F.lit(SEED), whole(), "doc_id").alias("key2"),
        whole().alias("text"),
    )


def least_row() -> Column:
    """Smallest id (null last), with the keys of its row."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key1", "key2"))


def sized(rows: DataFrame) -> DataFrame:
    """Rows (node, code, label, ...) of nodes that hold more than one label, with the node's ``size``."""
    sizes = (
        rows.groupBy("node")
        .agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("least"), F.max("label").alias("most"))
        .where("least <> most")
        .select("node", "size")
    )
    return stored(rows.join(sizes, "node"), "nodes")


def dealt(rows: DataFrame, branch: Callable[[DataFrame], DataFrame], levels: int, every: bool) -> DataFrame:
    """Members (node, at, code, label, side) of nodes small enough to compare.

    ``rows`` are (node, at, code, label). Rows of larger nodes go through ``branch`` to nodes of
    the next level, whose ``at`` is -1. What is large after ``levels`` is cut into chunks: with
    ``every``, pairs of chunks, whose members are compared across ``side`` 0 and 1 (2: with all),
    so that no pair is missed; else each chunk by itself.
    """
    members: list[DataFrame] = []
    columns = ("node", "at", "code", "label")
    for level in range(levels):
        here = sized(rows)
        small = here.where(F.col("size") <= LIMIT)
        members.append(small.select(*columns, F.lit(2).alias("side")))
        large = here.where(F.col("size") > LIMIT)
        if large.isEmpty():
            return _together(members)
        if level < levels - 1:
            rows = stored(branch(large), "branches")
    chunks = F.ceil(F.col("size") / LIMIT).cast("int")
    own = F.pmod(F.xxhash64("code", "node"), chunks).cast("int")
    if every:
        # Chunk i meets every chunk j: once in node (i, j), from the side it is on.
        other = F.explode(F.sequence(F.lit(0), chunks - 1))
        cut = large.select(*columns, own.alias("own"), other.alias("other"))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    else:
        cut = large.select(*columns, own.alias("own"))
        low, high, side = F.col("own"), F.col("own"), F.lit(2)
    members.append(cut.select(F.xxhash64("node", low, high).alias("node"), F.lit(-1).alias("at"), "code", "label", side.alias("side")))
    return _together(members)


def _together(members: list[DataFrame]) -> DataFrame:
    out = members[0]
    for more in members[1:]:
        out = out.unionByName(more)
    return out


def cluster_nodes(node: np.ndarray, code: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Nodes of what hangs together by the pairs (a, b) of places, each within one node."""
    least = np.arange(len(node))
    while True:
        before = least.copy()
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        least = least[least]
        if np.array_equal(before, least):
            break
    with np.errstate(over="ignore"):
        return mixed(node.view(np.uint64) + mixed(code.view(np.uint64)[least])).view(np.int64)


def sets_of(docs: DataFrame, units: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """code and ``hashes`` (sorted, packed) of the wanted codes, from one text of each.

    ``units`` has code and ``least`` (see ``least_row``). Texts are cut down by the buckets of
    the wanted keys, sent out, before they are shuffled.
    """
    keys = stored(units.join(wanted, "code", "left_semi").select("code", "least.key1", "least.key2"), "wanted")
    bucket = F.pmod(F.col("key1"), F.lit(LOOKUP_BUCKETS)).alias("bucket")
    buckets = keys.select(bucket).distinct()
    texts = text_keys(docs).withColumn("bucket", bucket).join(F.broadcast(buckets), "bucket", "left_semi")

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: np.unique(shingle_hashes(text, size)).tobytes())

    found = texts.join(keys, ["key1", "key2"]).select("code", "text").dropDuplicates(["code"])
    return stored(found.select("code", packed("text").alias("hashes")), "sets")


def _linked(labels: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], numerator: int, denominator: int) -> list[tuple[int, int]]:
    """Places that link all members whose sets are alike enough, by exact sizes of what they share."""
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    present = np.zeros(ids.max() + 1, dtype=np.int64)
    root, found = labels.copy(), []
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, len(sets))
        small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        j = j[(root[j] != root[i]) & ((sides[j] == 2) | (sides[j] != sides[i])) & (denominator * small >= numerator * large)]
        if not len(j):
            continue
        own = ids[ends[i] - sizes[i] : ends[i]]
        present[own] = 1
        if 4 * len(j) >= len(sets) - i:
            starts = (ends - sizes)[i + 1 :]
            shared = np.add.reduceat(present[ids[starts[0] :]], starts - starts[0])[j - i - 1]
        else:
            shared = np.array([present[ids[ends[k] - sizes[k] : ends[k]]].sum() for k in j])
        present[own] = 0
        for k in j[denominator * shared >= numerator * (sizes[i] + sizes[j] - shared)].tolist():
            if root[k] != root[i]:
                found.append((i, k))
                root[root == root[k]] = root[i]
    return found


def confirmed(marked: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links (a, b) between the codes of marked rows (node, side, code, label).

    Within a node, all whose sets share ``numerator`` of ``denominator`` parts of their union
    are connected by links or have the same label already.
    """

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_nodes(batches):
            code, label, side = (rows[name].to_numpy() for name in ("code", "label", "side"))
            starts = node_starts(rows["node"].to_numpy())
            packed, pairs = rows["hashes"].to_list(), []
            for start, end in zip(starts, starts[1:]):
                if end - start > 1:
                    sets_ = [np.frombuffer(packed[k], dtype=np.uint64) for k in range(start, end)]
                    found = _linked(label[start:end], side[start:end], sets_, numerator, denominator)
                    pairs += [(code[start + x], code[start + y]) for x, y in found]
            yield pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    rows = marked.join(sets, "code").select("node", "side", "code", "label", "hashes")
    return stored(rows.repartition("node").sortWithinPartitions("node", "code").mapInPandas(linked, "a long, b long"), "links")
