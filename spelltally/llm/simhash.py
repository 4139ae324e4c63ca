"""Near copies by SimHash and a hierarchical index in Gray order.

Fingerprints that differ in at most ``distance`` bits agree in all bits of some choice of
blocks. Each choice is an upper node of the index: a masked bit pattern that Spark deals
out to tasks. Below it, a task sorts the codes by Gray rank, so that neighbours share
bits, factors what groups of neighbours share into nodes (a mask and its pattern), and
compares nodes first: a pair of groups whose patterns already differ too often is pruned
with all that is below. Codes that are linked already are not compared again, so a mass
of near copies gives as many links as it has members, not their square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spelltally.llm.common import node_starts, stored, whole_nodes

WORDS_PER_SHINGLE = 4
SEED = 42
DISTANCE = 4
BITS = 64
FANOUT = 8
# Pairs of nodes that are compared at once.
SLICE = 1 << 17
# Keys get longer, and choices of blocks more, until a key has so many codes on average.
CODES_PER_KEY = 4096
# Codes of a node beyond which it is dealt to several tasks; one in so many tells which ones are.
LARGEST_NODE, SAMPLED = 1 << 16, 16


def shingle_hashes(text: str | None, size: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Hashes of all shingles, repeats included.

    A-Z are lower-cased. Fewer words than ``size`` make one shingle, no word makes none.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    number, digest = max(1, len(words) - size + 1) if words else 0, xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(words[i : i + size]), SEED) for i in range(number)), dtype=np.uint64, count=number)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed 64-bit number; zero without hashes."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Hashes whose bits don't depend on single bits of the given ones."""
    with np.errstate(over="ignore"):
        x = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, size: int = WORDS_PER_SHINGLE) -> int:
    """Majority of the bits of all shingle hashes; no word gives zero."""
    return majority(shingle_hashes(text, size))


def fingerprint_of(text: Column, size: int = WORDS_PER_SHINGLE) -> Column:
    @F.pandas_udf("long")
    def codes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: fingerprint(text, size)).astype("int64")

    return codes(text)


def gray_rank(code: Column) -> Column:
    """The place of a code in the Gray order (the number whose Gray code it is)."""
    for shift in (32, 16, 8, 4, 2, 1):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def masks(distance: int, codes: int) -> list[int]:
    """Masks of which any two codes within the distance agree in one.

    The bits are cut into blocks; a mask keeps all but ``distance`` of them. The number of
    blocks makes keys long enough for the number of codes.
    """
    blocks = distance + 1
    while blocks < distance + 4 and codes >> (BITS * (blocks - distance) // blocks) > CODES_PER_KEY:
        blocks += 1
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(kept) for kept in combinations(block, blocks - distance)]


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


class GrayIndex:
    """Nodes over codes in Gray order. Level 0 holds the codes, each next level groups of them."""

    def __init__(self, codes: np.ndarray):
        self.levels = [(codes, codes)]
        while len(self.levels[-1][0]) > 1:
            every, some = self.levels[-1]
            starts = np.arange(0, len(every), FANOUT)
            self.levels.append((np.bitwise_and.reduceat(every, starts), np.bitwise_or.reduceat(some, starts)))

    def differences(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which all of node ``a`` differ from all of node ``b``."""
        every, some = self.levels[level]
        shared = ~(every[a] ^ some[a]) & ~(every[b] ^ some[b])
        return np.bitwise_count((every[a] ^ every[b]) & shared)

    def children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of nodes one level down, each unordered pair once."""
        step = np.arange(FANOUT)
        left = (a[:, None, None] * FANOUT + step[:, None] + 0 * step).ravel()
        right = (b[:, None, None] * FANOUT + 0 * step[:, None] + step).ravel()
        number = len(self.levels[level - 1][0])
        there = (left < number) & (right < number) & ((left < right) if level == 1 else (left <= right))
        return left[there], right[there]


def roots(codes: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For each code (distinct, in Gray order) the place of the first one it is linked to."""
    parent = np.arange(len(codes))

    def root(place: int) -> int:
        while parent[place] != place:
            parent[place] = parent[parent[place]]
            place = parent[place]
        return place

    def link(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)

    def flat() -> np.ndarray:
        labels = parent.copy()
        while not np.array_equal(labels, labels[labels]):
            labels = labels[labels]
        return labels

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(codes[a] ^ codes[b]) <= distance

    places = np.arange(len(codes) - 1)
    next_to = places[near(places, places + 1)]
    link(next_to, next_to + 1)
    index = GrayIndex(codes)
    top = len(index.levels) - 1
    todo = [(top, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))] if top else []
    labels = flat()
    while todo:
        level, a, b = todo.pop()
        if len(a) > SLICE:
            todo += [(level, a[i : i + SLICE], b[i : i + SLICE]) for i in range(0, len(a), SLICE)]
            continue
        first, last = labels, labels
        for _ in range(level):
            starts = np.arange(0, len(first), FANOUT)
            first, last = np.minimum.reduceat(first, starts), np.maximum.reduceat(last, starts)
        open_ = ~((first[a] == last[a]) & (first[b] == last[b]) & (first[a] == first[b]))
        open_ &= (index.differences(level, a, b) <= distance) if level else near(a, b)
        a, b = a[open_], b[open_]
        if level:
            if len(a):
                todo.append((level - 1, *index.children(level, a, b)))
        elif len(a):
            link(a, b)
            labels = flat()
    return flat()


def _links(batches: Iterator[pd.DataFrame], distance: int) -> Iterator[pd.DataFrame]:
    """Rows (node, code) sorted by node and Gray rank to pairs (code, code it is linked with)."""
    for rows in whole_nodes(batches):
        node, codes = rows["node"].to_numpy(), rows["code"].to_numpy()
        starts = node_starts(node)
        left, right = [codes[:0]], [codes[:0]]
        for a, b in zip(starts, starts[1:]):
            if b - a > 1:
                to = roots(codes[a:b].view(np.uint64), distance)
                moved = np.flatnonzero(to != np.arange(len(to)))
                left.append(codes[a:b][moved])
                right.append(codes[a:b][to[moved]])
        yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})


def dealt(codes: DataFrame, masks_: list[int]) -> DataFrame:
    """Rows (node, code): each code under each masked pattern, those of large nodes as pairs of chunks.

    One code in ``SAMPLED`` tells which nodes are large; every two codes of a node still meet.
    """
    pattern = F.explode(
        F.array(
            *(
                F.struct(F.lit(i).alias("mask"), F.col("code").bitwiseAND(F.lit(_signed(m))).alias("masked"))
                for i, m in enumerate(masks_)
            )
        )
    )
    rows = codes.select("code", pattern.alias("p")).select(F.xxhash64("p.mask", "p.masked").alias("node"), "code")
    sampled = rows.where(F.pmod(F.xxhash64("code", F.lit(SEED)), F.lit(SAMPLED)) == 0).groupBy("node").count()
    large = stored(
        sampled.select("node", F.ceil(F.col("count") * SAMPLED / LARGEST_NODE).cast("int").alias("chunks")).where("chunks > 1"),
        "near-large",
    )
    own = F.pmod(F.xxhash64("code", "node"), F.col("chunks")).cast("int")
    parts = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: F.xxhash64("node", F.least(own, other), F.greatest(own, other))
    )
    nodes = F.explode(F.when(F.col("chunks").isNull(), F.array("node")).otherwise(parts))
    return rows.join(large, "node", "left").select(nodes.alias("node"), "code")


def links(codes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) that connect all codes of the column ``code`` within the distance.

    Codes must be distinct. Every two codes that differ in at most ``distance`` bits are
    connected by a path of such pairs; others are not.
    """
    rows = (
        dealt(codes, masks(distance, codes.count()))
        .repartition("node")
        .withColumn("rank", F.shiftrightunsigned(gray_rank(F.col("code")), 1))
        .sortWithinPartitions("node", "rank", "code")
        .drop("rank")
    )
    return rows.mapInPandas(lambda batches: _links(batches, distance), "a long, b long").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """``code`` and ``root`` for each code with a link: the smallest code it can reach.

    Large and small stars in turn; each turn is written and read again, until nothing moves.
    """
    edges = stored(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "near-links",
    )

    def digest(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    before, now = None, digest(edges)
    while before != now:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        moved = small.select("a", F.col("m").alias("b")).unionByName(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        edges = stored(moved.distinct(), "near-stars")
        before, now = now, digest(edges)
    return edges.select(F.col("a").alias("code"), F.col("b").alias("root"))


def _rooted(codes: DataFrame, least: Column, distance: int) -> DataFrame:
    """``code``, ``least`` (of its texts) and ``root`` for each distinct ``code``.

    Texts with equal codes are one.
    """
    distinct = stored(codes.groupBy("code").agg(F.min(least).alias("least")), "near-codes")
    connected = components(links(distinct.drop("least"), distance))
    return distinct.join(connected, "code", "left").select("code", "least", F.coalesce("root", "code").alias("root"))


def near_duplicates(docs: DataFrame, size: int = WORDS_PER_SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, code (signed 64-bit fingerprint) and component_id, one row per document.

    Null and empty texts have fingerprint zero and are linked like any other. A component
    is named by its smallest doc_id; null if it has null ids only. Repeated rows give
    repeated rows. Other columns are not looked at; an empty input gives an empty result.
    """
    codes = stored(docs.select("doc_id", fingerprint_of(F.col("text"), size).alias("code")), "near-fingerprints")
    rooted = _rooted(codes, F.col("doc_id"), distance)
    # Stored, so that the join can split the rows of a component with many fingerprints.
    groups = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "near-groups")
    labels = rooted.join(groups, "root").select("code", "component_id")
    return codes.join(labels, "code").select("doc_id", "code", "component_id")
