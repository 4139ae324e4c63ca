"""Importance resampling: documents drawn towards the n-grams of a target.

Separators are collapsed to single spaces, and one overlapped scan with boundary lookarounds
stops at every word and emits the spans of all n-grams that start there. The CRC of a longer
n-gram goes on from that of the shorter one, so no n-gram is built as a text of its own.

Documents are scanned once; what is stored is each one's buckets, two bytes a feature. Counts
per bucket, weights and draws start from there. The largest scores are found by ranges and
offsets: no task holds more than its range, the driver sees one number per bucket and range.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spelltally.llm.common import quoted, stored

LONGEST, BUCKETS, SEED = 3, 10_000, 42
LEAST_WORDS, PERCENT = 20, 5
# Everything ASCII but digits and small letters; texts are lower-cased first.
SEPARATORS = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ngram_pattern(longest: int = LONGEST) -> regex.Pattern:
    """Stops at each word of a collapsed text: the word, then what makes it two words, three, ..."""
    return regex.compile(rb"(?<![^ ])([^ ]+)" + rb"((?: [^ ]+)?)" * (longest - 1) + rb"(?![^ ])")


def collapsed(text: bytes) -> bytes:
    """A-Z lower-cased, separators as single spaces between words."""
    return SEPARATORS.sub(b" ", text.lower()).strip(b" ")


def ngram_spans(text: bytes, longest: int = LONGEST) -> list[tuple[int, int]]:
    """Start and end of each n-gram in the collapsed text."""
    found = []
    for match in ngram_pattern(longest).finditer(text, overlapped=True):
        ends = [end for start, end in match.regs[1:] if end > start]
        found += [(match.start(), end) for end in ends]
    return found


def feature_buckets(text: bytes, pattern: regex.Pattern, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of each n-gram (repeats included)."""
    crcs, words = [], 0
    add = crcs.append
    for match in pattern.finditer(collapsed(text), overlapped=True):
        words += 1
        crc = 0
        for part in match.groups():
            if not part:
                break
            crc = crc32(part, crc)
            add(crc)
    return words, np.array(crcs, dtype=np.uint32) % np.uint32(buckets)


def _packed(buckets: int) -> np.dtype:
    return np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")


def features(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """The frame with ``text`` replaced by ``n_words``, ``n_features`` and ``buckets`` (packed numbers).

    ``text`` must be its last column.
    """
    own = texts.columns[:-1]
    kinds = ", ".join(f"{quoted_name(name)} {texts.schema[name].dataType.simpleString()}" for name in own)
    packed = _packed(buckets)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = ngram_pattern(longest)
        for batch in batches:
            words, sizes, rows = [], [], []
            for text in batch.column(len(own)):
                number, found = feature_buckets(text.as_py() or b"", pattern, buckets)
                words.append(number)
                sizes.append(len(found))
                rows.append(found.astype(packed).tobytes())
            made = [pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(own))] + made, names=[*own, "n_words", "n_features", "buckets"]
            )

    bytes_ = texts.select(*(quoted(name) for name in own), F.col("text").cast("binary").alias("text"))
    added = "n_words long, n_features long, buckets binary"
    return bytes_.mapInArrow(scanned, f"{kinds}, {added}" if kinds else added)


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def bucket_counts(made: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, over all rows of ``features``."""
    packed = _packed(buckets)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for row in batch.column(0):
                total += np.bincount(np.frombuffer(row.as_buffer(), dtype=packed), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "number"])

    per_task = made.select("buckets").mapInArrow(counted, "bucket long, number long")
    total = np.zeros(buckets, dtype=np.int64)
    for row in per_task.groupBy("bucket").agg(F.sum("number").alias("number")).collect():  # one row per bucket
        total[row["bucket"]] = row["number"]
    return total


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier a bucket is in the target, one added to each count."""
    buckets = len(documents)
    all_documents, all_target = float(documents.sum() + buckets), float(target.sum() + buckets)
    made = [
        math.floor(1000 * math.log(float(t + 1) * all_documents / (float(s + 1) * all_target)))
        for s, t in zip(documents.tolist(), target.tolist())
    ]
    return np.array(made, dtype=np.int64)


def weighed(made: DataFrame, gain: np.ndarray) -> DataFrame:
    """``features`` with ``weight``, the sum of gains, in place of the buckets."""
    own = [name for name in made.columns if name != "buckets"]
    kinds = ", ".join(f"{quoted_name(name)} {made.schema[name].dataType.simpleString()}" for name in own)
    packed = _packed(len(gain))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gain[np.frombuffer(row.as_buffer(), dtype=packed)].sum()) for row in batch.column(len(own))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(own))] + [pa.array(sums, pa.int64())], names=[*own, "weight"]
            )

    return made.select(*(quoted(name) for name in own), "buckets").mapInArrow(summed, f"{kinds}, weight long")


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw that the key decides."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``place`` from 1 in the given order, over all rows, without one task that sees them all."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A sorted task numbers its rows; the number of rows in the ranges before it is added.
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33).alias("_part")
    sizes = dict(dealt.groupBy(part).count().collect())  # one row per range
    before, offsets = 0, []
    for number in sorted(sizes):
        offsets.append((number, before))
        before += sizes[number]
    starts = F.broadcast(spark.createDataFrame(offsets, "_part long, _before long"))
    own = [quoted(name) for name in rows.columns]
    there = dealt.withColumn("_part", F.shiftright("_at", 33)).join(starts, "_part")
    return there.select(*own, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias("place"))


def scored(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank and text_hash, one row per document.

    ``rank`` numbers the drawn documents from 1: the ``percent`` of those with ``least_words``
    that have the highest scores, ties to the smaller id, then to the row stored first. The
    others have none. Null and empty texts have no features, weight 0 and a score by their id
    alone; a null id draws like an empty one and comes first among ties. Repeated rows are
    documents of their own. An empty target leaves every bucket its single count; no documents
    give no rows. Columns of ``docs`` but doc_id and text, and of ``target`` but text, aren't
    looked at.
    """
    named = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    made = stored(features(named, longest, buckets), "features")
    wanted = stored(features(target.select("text"), longest, buckets), "target-features")
    gain = gains(bucket_counts(made, buckets), bucket_counts(wanted, buckets))
    rows = weighed(made, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    # Its own number tells equal rows apart, also where ranges are cut.
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "scores")
    enough = F.col("n_words") >= least_words
    number = rows.where(enough).count() * percent // 100
    placed = numbered(rows, F.when(enough, F.col("score")).desc_nulls_last(), F.col("doc_id").asc(), F.col("_row").asc())
    rank = F.when(F.col("place") <= number, F.col("place"))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"), "text_hash")


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with their own columns. Of rows equal in id and text all come if one does."""
    drawn = scored(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("_id"), "text_hash").distinct()
    same = docs["doc_id"].eqNullSafe(drawn["_id"]) & (F.xxhash64(docs["text"]) == drawn["text_hash"])
    return docs.join(drawn, same, "left_semi")
