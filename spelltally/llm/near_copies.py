"""Near copies by wide SimHash fingerprints in a hierarchical Gray-order index.

Fingerprints of 256 bits are dealt out by the upper nodes of the index, masked bit patterns:
two texts that agree in all bits of some mask meet in its node. There the codes are sorted by
Gray rank, so that neighbours share bits, and what groups of neighbours share is factored into
nodes above them. Pairs of nodes are compared from the top: differences add up, and a pair
that differs too often already, or is linked already, is pruned with all that is below.

Fingerprints only find likely partners. A link is two texts whose sets of shingles share
enough of their union, confirmed on the full sets. Sets too small for fingerprints meet by
prefixes of their shingles instead, which misses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, comb, log2, pi

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spelltally.llm import overlap
from spelltally.llm.common import node_starts, quoted, stored, whole, whole_nodes, without
from spelltally.llm.simhash import FANOUT, SLICE, components, majority, mixed, shingle_hashes

SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5
BITS, WORDS, SEED = 64, 4, 42
# Bits in which two wide fingerprints may differ to be looked at. Of all bits 0.15 differ on
# average at a likeness of 0.8, and seldom (3 in 10,000) more than ``WIDE``.
WIDE, RECALL = 58, 0.998
# Texts that share the bits of a mask by chance, about; masks that link what is most alike first.
CODES_PER_MASK, FIRST_MASKS = 256, 6
# Sets up to this size find each other by prefixes.
SMALL_SET = 20
# Rows of a node that are compared pair by pair; rows up to which a node stays in one task.
FEW, LIMIT = 64, 4096
# One row in so many tells which nodes are larger.
SAMPLED = 16
NAMES = [f"w{i}" for i in range(WORDS)]


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """``WORDS`` majorities of the same shingles, each of hashes mixed once more."""
    words = []
    for _ in range(WORDS):
        words.append(majority(hashes))
        hashes = mixed(hashes)
    return words


def mask_recall(likeness: float, kept: int, number: int) -> float:
    """Chance that two large sets of that likeness agree in a mask's bits and differ in ``WIDE`` at most."""
    bits, turned = BITS * WORDS, acos(2 * likeness / (1 + likeness)) / pi
    found = 0.0
    for apart in range(WIDE + 1):
        agree = comb(bits - apart, kept) / comb(bits, kept)
        found += comb(bits, apart) * turned**apart * (1 - turned) ** (bits - apart) * (1 - (1 - agree) ** number)
    return found


def masks(codes: int, likeness: float) -> np.ndarray:
    """Masks (rows of ``WORDS`` words) of random bits.

    More codes need more bits a mask, and those more masks, until pairs exactly as alike as
    asked for are found with chance ``RECALL``.
    """
    kept = int(min(24, max(4, log2(max(codes, 1) / CODES_PER_MASK))))
    low, high = 1, 1
    while mask_recall(likeness, kept, high) < RECALL:
        low, high = high, 2 * high
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if mask_recall(likeness, kept, middle) >= RECALL else (middle + 1, high)
    rng = np.random.default_rng(SEED)
    chosen = np.zeros((high, BITS * WORDS), dtype=np.uint8)
    for row in chosen:
        row[rng.choice(BITS * WORDS, kept, replace=False)] = 1
    return np.packbits(chosen, axis=1).view(">u8").astype(np.uint64)


def prefix_length(size: int, share: float) -> int:
    """So many of the smallest shingles that two sets alike enough have one of them in common."""
    return size - int(np.ceil(share * size - 1e-9)) + 1


def printed(docs: DataFrame, size: int, share: float) -> DataFrame:
    """doc_id, key1, key2, code (of the set), n_shingles, prefix and the words of the fingerprint."""
    longest = int(SMALL_SET / share + 1e-9)

    @F.pandas_udf(", ".join(["code long, n_shingles long, prefix array<long>", *(f"{name} long" for name in NAMES)]))
    def prints(texts: pd.Series) -> pd.DataFrame:
        made = []
        for text in texts:
            hashes = np.unique(shingle_hashes(text, size))
            code = np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)
            short = 0 < len(hashes) <= longest
            prefix = hashes[: prefix_length(len(hashes), share)] if short else hashes[:0]
            made.append((int(code), len(hashes), prefix.view(np.int64), *wide_fingerprint(hashes)))
        return pd.DataFrame(made, columns=["code", "n_shingles", "prefix", *NAMES])

    rows = overlap.text_keys(docs)
    return rows.select("doc_id", "key1", "key2", prints("text").alias("p")).select("doc_id", "key1", "key2", "p.*")


def gray_order(words: np.ndarray) -> np.ndarray:
    """The order of rows of words by Gray rank, the first word being the highest."""
    ranks, odd = [], np.zeros(len(words), dtype=np.uint64)
    for column in words.T:
        rank = column.copy()
        for shift in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(shift)
        rank ^= np.uint64(0) - odd  # an odd number of ones so far turns all that follows
        odd = rank & np.uint64(1)
        ranks.append(rank)
    return np.lexsort(ranks[::-1])


def gray_pairs(words: np.ndarray, label: np.ndarray, bound: int = WIDE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that differ in at most ``bound`` bits and have different labels.

    The codes stand in Gray order in leaves of ``FANOUT``. A leaf, and each node above, knows
    what its codes share: the bits set in all, the bits set in some, the smallest and the largest
    label. Codes of two leaves are compared when no node above has pruned the pair.
    """
    number, order = len(words), gray_order(words)
    leaves = -(-number // FANOUT)
    # The last leaf is filled up with its last code.
    filled = np.r_[order, np.full(leaves * FANOUT - number, order[-1])]
    codes = [column.reshape(leaves, FANOUT) for column in np.ascontiguousarray(words[filled].T)]
    labels, real = label[filled].reshape(leaves, FANOUT), (np.arange(len(filled)) < number).reshape(leaves, FANOUT)
    levels = [
        (
            [np.bitwise_and.reduce(c, axis=1) for c in codes], [np.bitwise_or.reduce(c, axis=1) for c in codes],
            labels.min(axis=1), labels.max(axis=1),
        )
    ]
    while len(levels[-1][2]) > 1:
        every, some, least, most = levels[-1]
        starts = np.arange(0, len(least), FANOUT)
        levels.append(
            (
                [np.bitwise_and.reduceat(c, starts) for c in every], [np.bitwise_or.reduceat(c, starts) for c in some],
                np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts),
            )
        )
    step = np.arange(FANOUT)
    upper = step[:, None] < step
    first = np.zeros(1, dtype=np.int64)
    todo, left, right = [(len(levels) - 1, first, first)], [], []
    while todo:
        level, a, b = todo.pop()
        if len(a) > SLICE // FANOUT**2:
            size = SLICE // FANOUT**2
            todo += [(level, a[i : i + size], b[i : i + size]) for i in range(0, len(a), size)]
            continue
        every, some, least, most = levels[level]
        open_ = (least[a] != most[a]) | (least[b] != most[b]) | (least[a] != least[b])
        a, b = a[open_], b[open_]
        apart = np.zeros(len(a), dtype=np.uint16)
        for e, s in zip(every, some):
            apart += np.bitwise_count((e[a] ^ e[b]) & ~(e[a] ^ s[a]) & ~(e[b] ^ s[b]))
        a, b = a[apart <= bound], b[apart <= bound]
        if level:
            x = (a[:, None, None] * FANOUT + step[:, None] + 0 * step).ravel()
            y = (b[:, None, None] * FANOUT + 0 * step[:, None] + step).ravel()
            there = (y < len(levels[level - 1][2])) & (x <= y)
            todo.append((level - 1, x[there], y[there]))
        elif len(a):
            apart = np.zeros((len(a), FANOUT, FANOUT), dtype=np.uint16)
            for c in codes:
                apart += np.bitwise_count(c[a][:, :, None] ^ c[b][:, None, :])
            near = (apart <= bound) & (labels[a][:, :, None] != labels[b][:, None, :])
            near &= real[a][:, :, None] & real[b][:, None, :]
            near[a == b] &= upper
            pair, i, j = np.nonzero(near)
            left.append(order[a[pair] * FANOUT + i])
            right.append(order[b[pair] * FANOUT + j])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def member_rows(units: DataFrame, labels: DataFrame, masks_: np.ndarray, first: int, last: int, prefixes: bool) -> DataFrame:
    """Rows (node, at, code, label, n_shingles, words) of the masks ``first`` to ``last``, and of prefixes (at: -1)."""
    columns = ["code", "label", "n_shingles", *NAMES]
    known = units.where("n_shingles > 0").join(labels, "code")
    at = F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("at")
    bits = [F.array(*(F.lit(int(m)) for m in column.view(np.int64))) for column in masks_.T]
    masked = [F.col(name).bitwiseAND(F.get(mask, F.col("at"))) for name, mask in zip(NAMES, bits)]
    rows = known.select(*columns, at).select(F.xxhash64("at", *masked).alias("node"), "at", *columns)
    if not prefixes:
        return rows
    shared = known.select(*columns, F.explode("prefix").alias("shingle"))
    return rows.unionByName(shared.select(F.xxhash64(F.lit("prefix"), "shingle").alias("node"), F.lit(-1).alias("at"), *columns))


def split(rows: DataFrame, every: bool) -> DataFrame:
    """The rows with ``side``, those of large nodes dealt to several nodes.

    Which nodes are large, and which label most of their rows have, is told by one code in
    ``SAMPLED``; it decides where pairs are compared, not whether. With ``every``, chunks of rows
    with other labels meet each other and all chunks of that label, whose own pairs are linked
    already. Without, chunks stand alone.
    """
    counted = rows.where(F.pmod(F.xxhash64("code", F.lit(SEED)), F.lit(SAMPLED)) == 0).groupBy("node", "label").count()
    large = (
        counted.groupBy("node")
        .agg(F.sum("count").alias("number"), F.max("count").alias("own"), F.max_by("label", F.struct("count", "label")).alias("main"))
        .where(F.col("number") * SAMPLED * 2 >= LIMIT)
        .select(
            "node",
            "main",
            F.greatest(F.lit(1), F.ceil((F.col("number") - F.col("own")) * SAMPLED / LIMIT)).cast("int").alias("others"),
            F.ceil(F.col("own") * SAMPLED / LIMIT).cast("int").alias("mains"),
        )
    )
    large = stored(large, "large-nodes")
    found = rows.join(large, "node", "left")
    is_main = F.col("label") == F.col("main")
    place = F.pmod(F.xxhash64("code", "node"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")

    def node(kind: str, a: Column, b: Column, side: Column) -> Column:
        return F.struct(F.xxhash64("node", F.lit(kind), a, b).alias("node"), side.cast("int").alias("side"))

    if every:
        others, mains = F.sequence(F.lit(0), F.col("others") - 1), F.sequence(F.lit(0), F.col("mains") - 1)
        to_others = F.transform(
            others,
            lambda j: node("other", F.least(j, place), F.greatest(j, place), F.when(j == place, 2).otherwise((place > j).cast("int"))),
        )
        to_mains = F.transform(mains, lambda j: node("main", place, j, F.lit(0)))
        from_main = F.transform(others, lambda i: node("main", i, place, F.lit(1)))
        dealt = F.when(is_main, from_main).otherwise(F.concat(to_others, to_mains))
    else:
        dealt = F.array(node("alone", is_main.cast("int"), place, F.lit(2)))
    alone = F.array(F.struct(F.col("node").alias("node"), F.lit(2).alias("side")))
    nodes = F.explode(F.when(F.col("main").isNull(), alone).otherwise(dealt)).alias("n")
    rest = [name for name in rows.columns if name != "node"]
    return found.select(nodes, *rest).select("n.node", "n.side", *rest)


def _marked(rows: DataFrame, masks_: np.ndarray, first: int, share: float) -> DataFrame:
    """Rows (node, side, code, label) that have a likely partner with another label.

    A pair is marked in the first mask's node it shares, or by prefixes; what hangs together by
    such pairs makes a node of its own.
    """

    def pairs_of(node, at, side, label, size, words) -> tuple[np.ndarray, np.ndarray]:
        starts = node_starts(node)
        sizes = np.diff(starts)
        until = np.repeat(np.where(sizes <= FEW, starts[1:], 0), sizes)
        left, right = [], []
        a = np.flatnonzero(until)
        for step in range(1, FEW):
            a = a[a + step < until[a]]
            if not len(a):
                break
            left.append(a[label[a] != label[a + step]])
            right.append(left[-1] + step)
        for start, end in zip(starts[:-1][sizes > FEW], starts[1:][sizes > FEW]):
            # Prefixes have no bound on differing bits.
            x, y = gray_pairs(words[start:end], label[start:end], WIDE if at[start] >= 0 else BITS * WORDS)
            left.append(x + start)
            right.append(y + start)
        none = np.zeros(0, dtype=np.int64)
        a, b = np.concatenate([none, *left]), np.concatenate([none, *right])
        kept = [none], [none]
        for low in range(0, len(a), SLICE):
            x, y = a[low : low + SLICE], b[low : low + SLICE]
            there = ((side[x] == 2) | (side[x] != side[y])) & (np.minimum(size[x], size[y]) >= share * np.maximum(size[x], size[y]) - 1e-9)
            x, y = x[there], y[there]
            apart = words[x] ^ words[y]
            there = (at[x] < 0) | (np.bitwise_count(apart).sum(axis=1, dtype=np.int64) <= WIDE)
            x, y, apart = x[there], y[there], apart[there]
            fresh = np.ones(len(x), dtype=bool)
            for number in range(first, int(at[x].max(initial=-1))):
                todo = np.flatnonzero(fresh & (at[x] > number))
                fresh[todo[((apart[todo] & masks_[number]) == 0).all(axis=1)]] = False
            kept[0].append(x[fresh])
            kept[1].append(y[fresh])
        return np.concatenate(kept[0]), np.concatenate(kept[1])

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_nodes(batches):
            node, at, side, label, size, code = (frame[n].to_numpy() for n in ("node", "at", "side", "label", "n_shingles", "code"))
            words = frame[NAMES].to_numpy().view(np.uint64)
            a, b = pairs_of(node, at, side, label, size, words)
            rows = np.unique(np.concatenate([a, b]))
            if not len(rows):
                continue
            own = overlap.cluster_nodes(node, code, a, b)
            yield pd.DataFrame({"node": own[rows], "side": side[rows], "code": code[rows], "label": label[rows]})

    sorted_ = rows.repartition("node").sortWithinPartitions("node", "code")
    return stored(sorted_.mapInPandas(compared, "node long, side int, code long, label long"), "marked")


def found_links(
    docs: DataFrame, units: DataFrame, labels: DataFrame, masks_: np.ndarray, first: int, last: int, every: bool,
    size: int, numerator: int, denominator: int,
) -> DataFrame:
    """Links (a, b) between codes of different labels, by the masks ``first`` to ``last``; prefixes go with ``every``."""
    rows = split(member_rows(units, labels, masks_, first, last, every), every)
    marked = _marked(rows, masks_, first, numerator / denominator)
    sets = overlap.sets_of(docs, units, marked.select("code").distinct(), size)
    return overlap.confirmed(marked, sets, numerator, denominator)


def rooted(units: DataFrame, links: DataFrame) -> DataFrame:
    joined = units.select("code").join(components(links), "code", "left")
    return stored(joined.select("code", F.coalesce("root", "code").alias("label")), "labels")


def grouped(docs: DataFrame, size: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> tuple[DataFrame, DataFrame]:
    """Units (code, least row, ...) of distinct sets, and the ``label`` of each one's component."""
    share = numerator / denominator
    rows = stored(printed(docs, size, share), "prints")
    units = stored(
        rows.groupBy("code").agg(overlap.least_row().alias("least"), *(F.first(n).alias(n) for n in ("n_shingles", "prefix", *NAMES))),
        "units",
    )
    masks_ = masks(units.count(), share)
    cut = min(FIRST_MASKS, len(masks_) - 1)
    alone = units.select("code", F.col("code").alias("label"))
    begun = found_links(docs, units, alone, masks_, 0, cut, False, size, numerator, denominator)
    labels = rooted(units, begun)
    more = found_links(docs, units, labels, masks_, cut, len(masks_), True, size, numerator, denominator)
    return units, rooted(units, begun.unionByName(more))


def one_of_each(docs: DataFrame, size: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """One document of each component, the one with the smallest id, with its own columns.

    Texts are linked when their sets of shingles share ``numerator`` of ``denominator`` parts of
    their union, confirmed on full sets: no link is wrong but for equal 64-bit hashes. Pairs of
    which one set has at most ``SMALL_SET`` shingles are all found, larger ones at the bound with
    chance ``RECALL``, more alike ones more surely. Texts without words, null ones too, are one
    component. Null ids come last; of rows equal in id and text one stays. An empty input gives
    an empty result.
    """
    own = without(docs, "_key1", "_key2")
    units, labels = grouped(docs, size, numerator, denominator)
    chosen = labels.join(units.select("code", "least"), "code").groupBy("label").agg(F.min("least").alias("least"))
    chosen = stored(chosen.select(F.col("least.key1").alias("_key1"), F.col("least.key2").alias("_key2")), "chosen")
    keyed = own.withColumns({"_key1": F.xxhash64("doc_id", whole()), "_key2": F.xxhash64(F.lit(SEED), whole(), "doc_id")})
    kept = keyed.join(chosen, ["_key1", "_key2"], "left_semi").dropDuplicates(["_key1", "_key2"])
    return kept.select(*(quoted(name) for name in own.columns))
