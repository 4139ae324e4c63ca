"""Near copies by a chosen-path similarity join on sets of shingles.

A text's set is drawn down to minwise tokens: under each of ``TOKENS`` hash functions, the
smallest value of its shingles, which two sets share with a chance equal to their likeness.
Independent trees branch texts by tokens that each node selects: the root by two of its own,
a node with too many members by one or two picked by the node's name, about one over the
likeness on average, so that like pairs stay together as often as they are cut and others die
out. Nodes with few members are compared exhaustively, by all tokens first, then on the full
sets. Trees are repeated until a pair right at the bound is found with chance ``recall``.

A few trees come first and link what is most alike; nodes whose members are linked already
are passed over by the others, so masses of near copies need no further branching.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spelltally.llm import overlap
from spelltally.llm.common import node_starts, stored, whole_nodes
from spelltally.llm.simhash import components, shingle_hashes

WORDS_PER_SHINGLE = 5
# Least likeness, as a fraction.
NUMERATOR, DENOMINATOR = 85, 100
TOKENS, SEED = 128, 42
# Two tokens a root: trees that come first, and those after them.
FIRST_TREES, LATER_TREES, PER_ROOT = 2, 8, 2
# Levels of nodes, the root's children being the first.
LEVELS = 8
# Texts are compared on full sets when so many tokens, or more, have the same last byte. A pair at
# the bound has 109 on average and fewer than this with a chance of 1 in 2,000,000.
LEAST_SAME = 88
# Shingles hashed at once.
PORTION = 4096


def token_functions(number: int = TOKENS, seed: int = SEED) -> np.ndarray:
    """Odd multipliers; a hash times one of them orders the shingles anew."""
    return np.random.default_rng(seed).integers(0, 1 << 63, size=number).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(hashes: np.ndarray, functions: np.ndarray) -> np.ndarray:
    """The high half of the smallest product under each function."""
    least = np.full(len(functions), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(hashes), PORTION):
            part = hashes[start : start + PORTION]
            np.minimum(least, (part[:, None] * functions).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def printed(docs: DataFrame, size: int = WORDS_PER_SHINGLE) -> DataFrame:
    """doc_id, key1, key2, code (of the set), n_shingles, tokens of the roots, and the last byte of all tokens."""
    roots = PER_ROOT * (FIRST_TREES + LATER_TREES)

    @F.pandas_udf("code long, n_shingles long, roots array<int>, bytes binary")
    def prints(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        functions, made = token_functions(), []
        for text in texts:
            hashes = np.unique(shingle_hashes(text, size))
            tokens = minwise(hashes, functions)
            code = np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)
            made.append((int(code), len(hashes), tokens[:roots].view(np.int32), tokens.astype(np.uint8).tobytes()))
        return pd.DataFrame(made, columns=["code", "n_shingles", "roots", "bytes"])

    rows = overlap.text_keys(docs)
    return rows.select("doc_id", "key1", "key2", prints("text").alias("p")).select("doc_id", "key1", "key2", "p.*")


def survival(likeness: float, level: int, share: float = NUMERATOR / DENOMINATOR) -> float:
    """Chance that a pair shares a node at a level (1: the root's children) below one token of a root."""
    two = 1 / share - 1  # chance that a node picks a second token
    alive = 1.0
    for _ in range(level - 1):
        one = likeness * alive
        alive = (1 - two) * one + two * (1 - (1 - one) ** 2)
    return likeness * alive


def recall(likeness: float, level: int = LEVELS) -> float:
    """Chance that some later tree finds a pair, if all nodes above the level are too large to compare."""
    return 1 - (1 - survival(likeness, level)) ** (PER_ROOT * LATER_TREES)


def _children(units: DataFrame, share: float):
    """Rows of large nodes, branched by tokens that the node picks."""

    def pick(salt: int) -> Column:
        at = (F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(TOKENS)) + 1).cast("int")
        return F.xxhash64("node", F.lit(salt), F.substr(F.col("bytes"), at, F.lit(1)))

    second = F.pmod(F.xxhash64("node", F.lit("second")), F.lit(10_000)) < int(round((1 / share - 1) * 10_000))

    def branch(large: DataFrame) -> DataFrame:
        picked = F.when(second, F.array(pick(0), pick(1))).otherwise(F.array(pick(0)))
        rows = large.select("node", "code", "label").join(units.select("code", "bytes"), "code")
        return rows.select(F.explode(picked).alias("node"), F.lit(-1).alias("at"), "code", "label")

    return branch


def _marked(members: DataFrame, units: DataFrame, first: int, last: int, share: float) -> DataFrame:
    """Members (node, side, code, label) that have a likely partner with another label.

    A pair that shares several root tokens is marked at the first of them whose node is small. What
    hangs together by such pairs makes a node of its own.
    """
    small = F.col("at") >= 0
    by_code = members.groupBy("code", "label").agg(
        F.collect_list(F.struct("node", "at", "side")).alias("nodes"),  # bounded by the trees and levels
        F.coalesce(F.bit_or(F.when(small, F.expr("shiftleft(1L, at)"))), F.lit(0).cast("long")).alias("small"),
    )
    known = units.select("code", "n_shingles", F.slice("roots", first + 1, last - first).alias("roots"), "bytes")
    rows = by_code.join(known, "code").select("code", "label", "small", "n_shingles", "roots", "bytes", F.explode("nodes").alias("n"))
    rows = rows.select("n.*", "code", "label", "small", "n_shingles", "roots", "bytes")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_nodes(batches):
            node, at, side, label, size = (frame[n].to_numpy() for n in ("node", "at", "side", "label", "n_shingles"))
            roots = np.stack(frame["roots"].to_list())
            tokens = np.frombuffer(b"".join(frame["bytes"]), dtype=np.uint8).reshape(len(frame), -1)
            places = np.arange(first, last)
            small = (frame["small"].to_numpy()[:, None] >> places & 1).astype(bool) & (places < at[:, None])
            starts = node_starts(node)
            until = np.repeat(starts[1:], np.diff(starts))
            left, right = [], []
            a, step = np.arange(len(frame)), 0
            while len(a):
                step += 1
                a = a[a + step < until[a]]
                x = a[(label[a] != label[a + step]) & ((side[a] == 2) | (side[a] != side[a + step]))]
                x = x[np.minimum(size[x], size[x + step]) >= share * np.maximum(size[x], size[x + step]) - 1e-9]
                x = x[np.count_nonzero(tokens[x] == tokens[x + step], axis=1) >= LEAST_SAME]
                x = x[~((roots[x] == roots[x + step]) & small[x]).any(axis=1)]
                left.append(x)
                right.append(x + step)
            a, b = np.concatenate(left), np.concatenate(right)
            found = np.unique(np.concatenate([a, b]))
            if len(found):
                frame["node"] = overlap.cluster_nodes(node, frame["code"].to_numpy(), a, b)
                yield frame.loc[found, ["node", "side", "code", "label"]]

    return stored(
        rows.repartition("node").sortWithinPartitions("node", "code").mapInPandas(compared, "node long, side int, code long, label long"),
        "marked",
    )


def found_links(
    docs: DataFrame, units: DataFrame, labels: DataFrame, first: int, last: int, every: bool, size: int, numerator: int, denominator: int
) -> DataFrame:
    """Links (a, b) found by the root tokens ``first`` to ``last``, between codes of different labels."""
    share = numerator / denominator
    roots = labels.join(units.select("code", "roots"), "code").select(
        "code", "label", F.posexplode(F.slice("roots", first + 1, last - first)).alias("at", "token")
    )
    at = F.col("at") + first
    rows = roots.select(F.xxhash64(at, "token").alias("node"), at.alias("at"), "code", "label")
    members = overlap.dealt(rows, _children(units, share), LEVELS if every else 3, every)
    marked = _marked(members, units, first, last, share)
    sets = overlap.sets_of(docs, units, marked.select("code").distinct(), size)
    return overlap.confirmed(marked, sets, numerator, denominator)


def rooted(units: DataFrame, links: DataFrame) -> DataFrame:
    """code and ``label``, the smallest code it is connected with."""
    joined = units.select("code").join(components(links), "code", "left")
    return stored(joined.select("code", F.coalesce("root", "code").alias("label")), "labels")


def joined(docs: DataFrame, size: int = WORDS_PER_SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per document.

    Texts are linked when their sets share ``numerator`` of ``denominator`` parts of their union,
    which is confirmed on full sets; ``component_id`` is the smallest doc_id that can be reached.
    Fewer words than ``size`` are one shingle. Null texts and texts without words have an empty
    set, which is linked with nothing. Null ids come after all others: a component of null ids
    only has none, and its documents are kept. Repeated rows give repeated rows; columns but
    doc_id and text aren't looked at; an empty input gives an empty result. Shingles and sets
    are told apart by 64-bit hashes.
    """
    rows = stored(printed(docs, size), "prints")
    units = stored(
        rows.where("n_shingles > 0").groupBy("code").agg(
            overlap.least_row().alias("least"), *(F.first(name).alias(name) for name in ("n_shingles", "roots", "bytes"))
        ),
        "units",
    )
    cut, end = PER_ROOT * FIRST_TREES, PER_ROOT * (FIRST_TREES + LATER_TREES)
    alone = units.select("code", F.col("code").alias("label"))
    begun = found_links(docs, units, alone, 0, cut, False, size, numerator, denominator)
    labels = rooted(units, begun)
    more = found_links(docs, units, labels, cut, end, True, size, numerator, denominator)
    labels = rooted(units, begun.unionByName(more))
    least = units.select("code", F.col("least.doc_id").alias("least")).join(labels, "code")
    groups = stored(least.groupBy("label").agg(F.min("least").alias("component_id")), "groups")
    known = stored(labels.join(groups, "label").select("code", "component_id"), "components")
    named = rows.select("doc_id", "n_shingles", "code").join(known, "code", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
