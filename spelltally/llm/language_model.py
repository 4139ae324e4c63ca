"""Deleted interpolation of word bigrams, unigrams and a uniform floor.

p(w | v) = l2 c(v, w) / c(v) + l1 c(w) / N + l0 / (V + 1), the weights l depending on how
often the context v was seen. They are learned by expectation-maximisation on a part of
the training texts whose n-grams are kept out of the counts it is predicted with. A text
is its words and one end; the end is also the context of the first word.

Texts are worked on in portions. A portion sends each different n-gram once to the task
that counts it, as sorted hashes, and gets the counts in the same order. So a frequent
n-gram is one entry per portion, and no vocabulary is ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spelltally.llm.common import fold, stored

FOLDS, HELD_OUT = 7, 2
# Of the training texts, one in so many is predicted from the others to learn the weights.
DELETED = 10
PORTION_TOKENS = 2_000_000
# Tokens of a portion that are scored at once.
SCORED_TOKENS = 250_000
# Least number of counting groups, and groups per input partition: a group's memory stays bounded.
LEAST_GROUPS, GROUPS_PER_PARTITION = 96, 3
END = b""
# Context buckets: 0, then powers of two. Cells of the held-out statistics per bucket.
CONTEXTS, RATIOS, COUNTS = 24, 65, 161
ROUNDS = 60
FLOOR = 1e-6
NOWHERE = -1


def packed(numbers: np.ndarray) -> bytes:
    """Bytes of equal significance together, then compressed."""
    raw = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(raw.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


@dataclass
class Portion:
    """Token numbers of some texts; number 0 is the end. ``hashes`` has a hash per number."""

    tokens: np.ndarray
    lengths: np.ndarray
    parts: np.ndarray  # per text: 0 counted, 1 deleted, 2 held out
    hashes: np.ndarray

    def paired(self) -> Portion:
        """Adds the pairs of tokens and the keys of words and pairs."""
        ends = np.cumsum(self.lengths)
        self.starts = ends - self.lengths
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = 0
        self.before = before
        size = len(self.hashes)
        pairs, pair_of = np.unique(before.astype(np.int64) * size + self.tokens, return_inverse=True)
        self.pair_of = pair_of.astype(np.int32)
        left, right = pairs // size, pairs % size
        with np.errstate(over="ignore"):
            mixed = self.hashes[left] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[right]
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(29)
        # The last bit tells words from pairs.
        self.keys = np.concatenate([self.hashes & ~np.uint64(1), mixed | np.uint64(1)])
        return self

    def dealt(self, groups: int) -> tuple[np.ndarray, np.ndarray]:
        """The group of each key, and an order by group and key."""
        group = ((self.keys >> np.uint64(1)) % np.uint64(groups)).astype(np.int64)
        return group, np.lexsort((self.keys, group))

    def counts(self, part: int) -> np.ndarray:
        own = np.repeat(self.parts == part, self.lengths).astype(np.float64)
        size = len(self.hashes)
        words = np.bincount(self.tokens, weights=own, minlength=size)
        return np.concatenate([words, np.bincount(self.pair_of, weights=own, minlength=len(self.keys) - size)]).astype(np.uint32)

    def payload(self) -> dict[str, bytes]:
        return {
            "tokens": packed(self.tokens), "lengths": packed(self.lengths),
            "parts": packed(self.parts), "hashes": packed(self.hashes),
        }

    @staticmethod
    def of(row) -> Portion:
        return Portion(
            unpacked(row.tokens, np.uint32), unpacked(row.lengths, np.int64),
            unpacked(row.parts, np.uint8), unpacked(row.hashes, np.uint64),
        )


def portions(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list, Portion]]:
    """Portions of ``doc_id``, ``text`` and ``part`` in the order of the input, each with a name."""
    number = 0

    def closed() -> tuple[int, list, Portion]:
        nonlocal number
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(w) for w in known), dtype=np.uint64, count=len(known))
        portion = Portion(
            np.concatenate(texts), np.array([len(t) for t in texts], dtype=np.int64), np.array(parts, dtype=np.uint8), hashes
        )
        where = TaskContext.get()
        place = (where.partitionId() if where else 0) * 1_000_003 + number
        number += 1
        name = digest(portion.tokens.tobytes() + repr(ids).encode(), place) >> 1
        return name, ids, portion

    known, texts, parts, ids, size = {END: 0}, [], [], [], 0
    for batch in batches:
        for key, text, part in zip(batch["doc_id"], batch["text"], batch["part"]):
            words = (text or "").encode("utf-8", "replace").lower().split()
            texts.append(
                np.fromiter((known.setdefault(w, len(known)) for w in (*words, END)), dtype=np.uint32, count=len(words) + 1)
            )
            parts.append(part)
            ids.append(key)
            size += len(words) + 1
            if size >= PORTION_TOKENS:
                made = closed()
                known, texts, parts, ids, size = {END: 0}, [], [], [], 0
                yield made
    if texts:
        made = closed()
        known, texts = {END: 0}, []
        yield made


def _counted(rows: pd.DataFrame) -> pd.DataFrame:
    """One group's n-grams of all portions: adds up and answers each portion in its own order."""
    rows = rows.sort_values("portion")
    keys = [np.cumsum(unpacked(k, np.uint64), dtype=np.uint64) for k in rows["keys"]]
    sizes = [len(k) for k in keys]
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    all_keys = np.zeros(place.max() + 1, dtype=np.uint64)
    all_keys[place] = np.concatenate(keys)
    totals = []
    for name in ("counted", "deleted"):
        own = np.concatenate([unpacked(c, np.uint32) for c in rows[name]])
        totals.append(np.bincount(place, weights=own, minlength=len(all_keys)).astype(np.uint32))
    word = all_keys & np.uint64(1) == 0
    numbers = [
        totals[0][word].sum(dtype=np.int64), np.count_nonzero(totals[0][word]),
        (totals[0] + totals[1])[word].sum(dtype=np.int64), np.count_nonzero((totals[0] + totals[1])[word]),
    ]
    cuts = np.cumsum([0, *sizes])
    group = int(rows["group"].iloc[0])
    answers = [
        (name, group, packed(totals[0][place[a:b]]), packed(totals[1][place[a:b]]), None)
        for name, a, b in zip(rows["portion"], cuts, cuts[1:])
    ]
    answers.append((NOWHERE, group, None, None, [float(n) for n in numbers]))
    return pd.DataFrame(answers, columns=["portion", "group", "counted", "deleted", "numbers"])


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(CONTEXTS - 1, np.log2(np.maximum(count, 1)).astype(np.int64) + 1), 0)


def cells(context: np.ndarray, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Cells of held-out tokens: the context's bucket, steps of p(w | v) and of c(w). Steps are quarter and half octaves."""
    ratio = np.where(pair > 0, 1 + np.minimum(RATIOS - 2, np.round(-2 * np.log2(np.maximum(pair, 1) / np.maximum(context, 1)))), 0)
    count = np.where(word > 0, 1 + np.minimum(COUNTS - 2, np.round(4 * np.log2(np.maximum(word, 1)))), 0)
    return ((context_bucket(context) * RATIOS + ratio) * COUNTS + count).astype(np.int64)


def interpolation(seen: np.ndarray, tokens: float, types: float) -> np.ndarray:
    """Weights (l2, l1, l0) per context bucket from the numbers of held-out tokens per cell."""
    seen = seen.reshape(CONTEXTS, RATIOS, COUNTS)
    ratio = np.where(np.arange(RATIOS) > 0, 2.0 ** (-(np.arange(RATIOS) - 1) / 2), 0.0)
    count = np.where(np.arange(COUNTS) > 0, 2.0 ** ((np.arange(COUNTS) - 1) / 4), 0.0)
    parts = np.stack(
        np.broadcast_arrays(ratio[:, None], count[None, :] / max(tokens, 1), np.full((RATIOS, COUNTS), 1 / (types + 1)))
    )

    def learned(numbers: np.ndarray, weights: np.ndarray) -> np.ndarray:
        for _ in range(ROUNDS):
            mixed = weights[:, None, None] * parts
            weights = (mixed / mixed.sum(axis=0) * numbers).sum(axis=(1, 2)) / max(numbers.sum(), 1e-12)
            weights = np.maximum(weights, FLOOR)
            weights /= weights.sum()
        return weights

    pooled = learned(seen.sum(axis=0), np.full(3, 1 / 3)) if seen.any() else np.full(3, 1 / 3)
    table = np.array([learned(n, pooled) if n.any() else pooled for n in seen])
    table[0] = [0.0, *(table[0, 1:] / table[0, 1:].sum())]
    return table


def _joined(portion_rows: pd.DataFrame, answers: pd.DataFrame, groups: int) -> pd.DataFrame:
    """A portion with the counts of its n-grams, and its deleted texts as numbers of tokens per cell."""
    columns = ["ids", "tokens", "lengths", "parts", "hashes", "counts", "cell", "seen", "numbers"]
    if not len(portion_rows):
        return pd.DataFrame([(*[None] * 8, n) for n in answers["numbers"]], columns=columns)
    row = portion_rows.iloc[0]
    portion = Portion.of(row).paired()
    _, order = portion.dealt(groups)
    answers = answers.sort_values("group")
    counted, deleted = (np.zeros(len(order), dtype=np.uint32) for _ in range(2))
    counted[order] = np.concatenate([unpacked(c, np.uint32) for c in answers["counted"]])
    deleted[order] = np.concatenate([unpacked(c, np.uint32) for c in answers["deleted"]])
    words = counted[: len(portion.hashes)]
    own = np.repeat(portion.parts == 1, portion.lengths)
    cell = cells(
        words[portion.before[own]], counted[len(words) :][portion.pair_of[own]], words[portion.tokens[own]]
    )
    cell, seen = np.unique(cell, return_counts=True)
    return pd.DataFrame(
        [(row.ids, row.tokens, row.lengths, row.parts, row.hashes, packed(counted + deleted), cell.tolist(), seen.tolist(), None)],
        columns=columns,
    )


def _scored(row, table: np.ndarray, tokens: float, types: float) -> Iterator[pd.DataFrame]:
    """The scores of a portion, some texts at a time; what is held besides its n-grams stays small."""
    portion = Portion.of(row).paired()
    counts = unpacked(row.counts, np.uint32)
    words, pairs = counts[: len(portion.hashes)], counts[len(portion.hashes) :]
    portion.keys = portion.hashes = counts = None
    first, ids = 0, list(row.ids)
    while first < len(ids):
        ends = np.cumsum(portion.lengths[first:])
        last = first + max(1, int(np.searchsorted(ends, SCORED_TOKENS, side="right")))
        starts = portion.starts[first:last]
        own = slice(starts[0], starts[0] + ends[last - first - 1])
        word, context = words[portion.tokens[own]].astype(np.float64), words[portion.before[own]]
        weights = table[context_bucket(context)]
        chance = weights[:, 0] * pairs[portion.pair_of[own]] / np.maximum(context, 1)
        chance += weights[:, 1] * word / max(tokens, 1) + weights[:, 2] / (types + 1)
        yield pd.DataFrame(
            {
                "doc_id": pd.Series(ids[first:last], dtype=object),
                "held_out": portion.parts[first:last] == 2,
                "n_tokens": portion.lengths[first:last],
                "n_known": np.add.reduceat((word > 0).astype(np.int64), starts - starts[0]),
                "train_tokens": int(tokens),
                "base_score": np.add.reduceat(np.log10((word + 1) / (tokens + types + 1)), starts - starts[0]),
                "score": np.add.reduceat(np.log10(chance), starts - starts[0]),
            }
        )
        first = last


def score_texts(docs: DataFrame, settled: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each text.

    Texts are read twice and must come in the same order both times. ``settled`` says that
    they do, as a table read from files does; any other frame is stored first.

    Learns from texts outside the held-out fold of ``doc_id``. A null text is an empty one,
    which has one token, its end. Repeated rows are texts of their own. Other columns are
    not looked at. Without training texts every word is unknown; an empty input gives an
    empty result. Words and pairs are told apart by 64-bit hashes. Ids may be of any type that
    a cast to text and back leaves as it is.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    part = F.when(fold("doc_id", FOLDS) == HELD_OUT, 2).otherwise((fold("doc_id", FOLDS * DELETED) % DELETED == 0).cast("int"))
    # Ids travel as text: beside a null, pandas would round large numbers.
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", part.alias("part"))
    texts = texts if settled else stored(texts, "language-texts")
    groups = max(LEAST_GROUPS, GROUPS_PER_PARTITION * texts.rdd.getNumPartitions())

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, _, portion in portions(batches):
            group, order = portion.paired().dealt(groups)
            counted, deleted = portion.counts(0)[order], portion.counts(1)[order]
            keys, cuts = portion.keys[order], np.searchsorted(group[order], np.arange(groups + 1))
            rows = [
                (name, g, packed(np.diff(keys[a:b], prepend=np.uint64(0))), packed(counted[a:b]), packed(deleted[a:b]))
                for g, (a, b) in enumerate(zip(cuts, cuts[1:]))
                if b > a
            ]
            yield pd.DataFrame(rows, columns=["portion", "group", "keys", "counted", "deleted"])

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, ids, portion in portions(batches):
            yield pd.DataFrame([{"portion": name, "ids": ids, **portion.payload()}])

    body = "tokens binary, lengths binary, parts binary, hashes binary"
    answers = (
        texts.mapInPandas(sent, "portion long, group int, keys binary, counted binary, deleted binary")
        .groupBy("group")
        .applyInPandas(_counted, "portion long, group int, counted binary, deleted binary, numbers array<double>")
    )
    whole = texts.mapInPandas(kept, f"portion long, ids array<string>, {body}")
    joined = stored(
        whole.groupBy("portion")
        .cogroup(answers.groupBy("portion"))
        .applyInPandas(
            lambda a, b: _joined(a, b, groups),
            f"ids array<string>, {body}, counts binary, cell array<long>, seen array<long>, numbers array<double>",
        ),
        "language-model",
    )
    numbers = joined.where("numbers IS NOT NULL").select(*(F.sum(F.col("numbers")[i]) for i in range(4))).first()
    fewer, fewer_types, tokens, types = (n or 0.0 for n in numbers)
    seen = np.zeros(CONTEXTS * RATIOS * COUNTS)
    pairs = joined.where("cell IS NOT NULL").select(F.explode(F.arrays_zip("cell", "seen")).alias("p"))
    for cell, number in pairs.groupBy("p.cell").agg(F.sum("p.seen")).collect():
        seen[cell] = number
    table = interpolation(seen, fewer, fewer_types)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples(index=False):
                yield from _scored(row, table, tokens, types)

    scores = joined.where("tokens IS NOT NULL").select("ids", "tokens", "lengths", "parts", "hashes", "counts").mapInPandas(
        scored,
        "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return scores.withColumn("doc_id", F.col("doc_id").cast(key))
