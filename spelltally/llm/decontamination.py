"""Benchmark decontamination by pigeonhole edit matching.

An item may occur with up to ``rate`` of its length in edits. Cut into one piece more than
that budget, at least one piece occurs unchanged. One automaton finds all pieces in a
text; around each hit Myers' bit-parallel algorithm finds the edit distance of the whole
item. Benchmark items go out in blocks of bounded size, one at a time, each against all texts.

White space at the ends of an item doesn't count. Items without a letter or digit are found
nowhere. Items shorter than ``SHORT`` characters, which may not be edited, are found at word
boundaries only, and those shorter than ``TINY``, which ordinary prose holds by chance, only in
texts that consist of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spelltally.llm.common import LOWER, UPPER, stored

RATE = 0.05
# Lengths below which an item needs word boundaries, or the text to itself.
SHORT, TINY = 20, 12
# Bytes of items in a block, about: bounds what the driver sees and sends at once. An item
# longer than that is a block by itself.
BLOCK_BYTES = 4 << 20
FOLDED = str.maketrans(UPPER, LOWER)


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """Offsets and texts of ``budget + 1`` pieces of nearly equal length."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def char_rows(pattern: str) -> dict[str, int]:
    """For each character a bit row of the places where the pattern has it."""
    rows: dict[str, int] = defaultdict(int)
    for place, char in enumerate(pattern):
        rows[char] |= 1 << place
    return dict(rows)


def best_end(pattern: str, text: str, rows: dict[str, int] | None = None) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and the first end of such a part."""
    length = len(pattern)
    rows = char_rows(pattern) if rows is None else rows
    full, last = (1 << length) - 1, 1 << (length - 1)
    up, down, distance = full, 0, length
    best = (length, 0)
    for place, char in enumerate(text, 1):
        same = rows.get(char, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        plus, minus = down | ~(across | up), up & across
        if plus & last:
            distance += 1
        elif minus & last:
            distance -= 1
        if distance < best[0]:
            best = (distance, place)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = (minus | ~(vertical | plus)) & full, plus & vertical
    return best


class Matcher:
    """The pieces of a block of items, ready to search texts."""

    def __init__(self, items: list[tuple[str | None, str]], rate: float = RATE):
        self.items = [(key, text.strip().translate(FOLDED)) for key, text in items]
        self.items = [(key, text) for key, text in self.items if any(map(str.isalnum, text))]
        self.budgets = [int(len(text) * rate) for _, text in self.items]
        self.rows = [char_rows(text) for _, text in self.items]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, (_, text) in enumerate(self.items):
            for offset, piece in pieces(text, self.budgets[number]):
                found[piece].append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def search(self, text: str | None) -> list[tuple[str | None, int, int, int]]:
        """(item key, distance, start, end), the best occurrence of each item in the text."""
        if not text or self.empty:
            return []
        text = text.translate(FOLDED)
        windows: dict[int, list[list[int]]] = defaultdict(list)
        own = len(text.strip())
        for end, (length, places) in self.automaton.iter(text):
            for number, offset in places:
                budget, begin = self.budgets[number], end + 1 - length - offset
                size = len(self.items[number][1])
                if size < SHORT and not budget:
                    inside = text[begin - 1 : begin].isalnum() or text[begin + size : begin + size + 1].isalnum()
                    if begin < 0 or inside or (size < TINY and own != size):
                        continue
                    windows[number].append([begin, begin + size])
                    continue
                a = max(0, begin - budget)
                b = min(len(text), begin + len(self.items[number][1]) + budget)
                windows[number].append([a, b])
        hits = []
        for number, spans in windows.items():
            key, item = self.items[number]
            spans.sort()
            merged = [spans[0]]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            tried = [(*best_end(item, text[a:b], self.rows[number]), a) for a, b in merged]
            distance, end, a = min(tried, key=lambda x: (x[0], x[2] + x[1]))
            if distance <= self.budgets[number]:
                # The reversed item against what ends there gives the start.
                _, back = best_end(item[::-1], text[a : a + end][::-1])
                hits.append((key, distance, a + end - back, a + end))
        return sorted(hits, key=lambda hit: (hit[2], hit[3], str(hit[0])))


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, str]]]:
    """The different items, ids as text, in blocks of about ``block_bytes``; the driver holds one at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.length(F.trim("text")) > 0).distinct()
    items = stored(items.withColumn("size", F.octet_length("text").cast("long")), "benchmark")
    long_ = F.col("size") > block_bytes
    total = items.where(~long_).agg(F.sum("size")).first()[0] or 0
    number = -(-2 * total // block_bytes)
    dealt = items.where(~long_).withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(number, 1))))
    wanted = [dealt.where(F.col("block") == n) for n in range(number)]
    rows = items.where(long_).select(F.xxhash64("item_id", "text").alias("key")).distinct()
    wanted += [items.where(long_ & (F.xxhash64("item_id", "text") == r.key)) for r in rows.toLocalIterator()]
    for block in wanted:
        yield sorted(((r[0], r[1]) for r in block.select("item_id", "text").collect()), key=repr)


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, distance, start, end.

    Letters A-Z and a-z are the same. The span is the occurrence with the least distance,
    the first of such. Null and empty texts hold nothing; a repeated row gives repeated
    hits, a repeated item is one; an empty benchmark or input gives no hits. Ids may be of any
    type that a cast to text and back leaves as it is, null ones included. Other columns are
    not looked at.
    """
    kinds = [frame.schema[name].dataType.simpleString() for frame, name in ((docs, "doc_id"), (benchmark, "item_id"))]
    # Ids travel as text: beside a null, pandas would round large numbers.
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    columns = ["doc_id", "item_id", "distance", "start", "end"]
    results = []
    for block in blocks(benchmark, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def found(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            matcher = Matcher(sent.value, rate)
            for batch in batches:
                hits = [(key, *hit) for key, text in zip(batch["doc_id"], batch["text"]) for hit in matcher.search(text)]
                yield pd.DataFrame(hits, columns=columns)

        results.append(stored(texts.mapInPandas(found, "doc_id string, item_id string, distance int, start int, end int"), "hits"))
        sent.unpersist()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, start int, end int"
    if not results:
        return docs.sparkSession.createDataFrame([], schema)
    hits = reduce(DataFrame.unionByName, results)
    return hits.withColumns({"doc_id": F.col("doc_id").cast(kinds[0]), "item_id": F.col("item_id").cast(kinds[1])})


def _clean_under(sent, rate: float):
    @F.pandas_udf("boolean")
    def is_clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(sent.value, rate)
        for batch in texts:
            yield batch.map(lambda text: not matcher.search(text)).astype("bool")

    return is_clean


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns and repeats.

    Each text decides for itself, so nothing is joined. What is left by one block of items is
    stored before the next goes out. Null and empty texts are clean; an empty benchmark leaves
    all documents.
    """
    before = None
    for block in blocks(benchmark, block_bytes):
        if before is not None:
            docs = stored(docs, "clean")
            before.unpersist()
        before = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.where(_clean_under(before, rate)(F.col("text")))
    return docs
