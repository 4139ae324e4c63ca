"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each shingle is hashed once. The top bits of the hash choose a bin, the smallest hash of a
bin is its value. An empty bin takes the value of a non-empty one, drawn by a hash of the
empty bin's number (optimal densification). Only the low-order bits of each value are
kept, and likeness is corrected for values that agree in those bits by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spelltally.llm.common import GAP, let, lower_ascii, stored, whole

BINS_LOG2 = 8
BINS = 1 << BINS_LOG2
WORDS_PER_SHINGLE = 5
# Bits of a hash below those that choose the bin. A bin whose value is all ones is empty.
VALUE_BITS = 63 - BINS_LOG2
EMPTY = (1 << VALUE_BITS) - 1
# Low-order bits kept per bin: one byte.
KEPT = 256
# Draws of a bin before all non-empty bins are ranked at once.
DRAWS = 6


def shingle_hashes(text: Column, size: int = WORDS_PER_SHINGLE) -> Column:
    """63-bit hashes of all shingles. Fewer words than ``size`` make one shingle, no words too."""

    def of_words(hashes: Column) -> Column:
        several = F.transform(
            F.sequence(F.lit(0), F.size(hashes) - size),
            lambda i: F.xxhash64(*(hashes[i + k] for k in range(size))),
        )
        single = F.array(F.xxhash64(F.array_join(hashes.cast("array<string>"), " ")))
        return F.when(F.size(hashes) >= size, several).otherwise(single)

    words = F.filter(F.split(lower_ascii(text), GAP), lambda word: word != "")
    hashed = let(F.transform(words, lambda word: F.xxhash64(word)), of_words)
    return F.transform(hashed, lambda h: F.shiftrightunsigned(h, 1))


def _bin_values(hashes: Column) -> Column:
    """The smallest hash of each bin without the bin's bits, ``EMPTY`` where there is none."""
    # One largest value per bin guarantees each bin a first element after sorting.
    ends = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.shiftleft(i.cast("long"), VALUE_BITS) + EMPTY)

    def firsts(ordered: Column) -> Column:
        bin_of = lambda x: F.shiftright(x, VALUE_BITS)
        kept = F.filter(ordered, lambda x, i: (i == 0) | (bin_of(x) != bin_of(ordered[i - 1])))
        return F.transform(kept, lambda x: x.bitwiseAND(F.lit(EMPTY)))

    # Index -1 is never looked up: the first test decides.
    return let(F.sort_array(F.concat(hashes, ends)), firsts)


def _densified(values: Column) -> Column:
    def filled(values: Column) -> Column:
        there = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: values[j] != EMPTY)

        def with_bins(there: Column) -> Column:
            def drawn(i: Column) -> Column:
                tries = (values[F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")] for t in range(DRAWS))
                ranked = F.transform(there, lambda j: F.struct(F.xxhash64(i, F.lit(DRAWS), j), j.alias("bin")))
                return F.coalesce(
                    *(F.nullif(value, F.lit(EMPTY)) for value in tries), values[F.array_min(ranked).getField("bin")]
                )

            return F.transform(values, lambda x, i: F.when(x != EMPTY, x).otherwise(drawn(i)))

        return let(there, with_bins)

    return let(values, filled)


def fingerprint(text: Column, size: int = WORDS_PER_SHINGLE) -> Column:
    """One byte per bin, as binary. Equal texts have equal fingerprints."""
    low = F.transform(
        _densified(_bin_values(shingle_hashes(text, size))),
        lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(KEPT - 1))), 2, "0"),
    )
    return F.unhex(F.array_join(low, ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints, 0 to 1."""
    same = F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))
    chance = 1.0 / KEPT
    return F.greatest(F.lit(0.0), (F.size(same) / F.lit(BINS) - chance) / (1 - chance))


def successors(keys: DataFrame, *order: str) -> DataFrame:
    """Add ``next``, a struct of the key that follows in the order; the first follows the last.

    Keys must be distinct. Ranges of keys are sorted apart, and only the first key of each
    range is passed on, so nothing is ordered in one task.
    """
    ranged = stored(
        keys.repartitionByRange(*(F.col(c).asc_nulls_first() for c in order)).withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    key = F.struct(*order)
    firsts = ranged.groupBy("_range").agg(F.min(key).alias("_first"))
    line = Window.partitionBy(F.lit(0)).orderBy("_range")
    after = firsts.select(
        "_range",
        F.coalesce(
            F.lead("_first").over(line),
            F.first("_first").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("_after"),
    )
    within = Window.partitionBy("_range").orderBy(*(F.col(c).asc_nulls_first() for c in order))
    return (
        ranged.withColumn("_next", F.lead(key).over(within))
        .join(F.broadcast(after), "_range")
        .withColumn("next", F.coalesce("_next", "_after"))
        .drop("_range", "_next", "_after")
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of two hashes of both, which joins need: unlike ids, it is never null."""
    texts = docs.select("doc_id", whole().alias("text"))
    return texts.select("*", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"))


def edited_texts(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (keys), text, edited_text, and the next document's next_doc_id, n1 and n2.

    The edited text ends in the first quarter of the next document by ``doc_id`` (null ids
    first, the first after the last) instead of its own last quarter. A null text is an
    empty one. Repeated rows count once when neighbours are looked for and give repeated
    results; a single document is its own neighbour; an empty input gives an empty result.
    Other columns are not looked at.
    """
    texts = _keyed(docs)
    keys = texts.groupBy("doc_id", "k1", "k2").agg(F.max(F.length("text")).alias("chars"))
    line = successors(keys, "doc_id", "k1", "k2").select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), "chars", F.col("next.k1").alias("k1"), F.col("next.k2").alias("k2")
    )
    line = stored(line, "neighbours")
    # Both joins read one exchange of the texts.
    heads = (
        texts.join(line, ["k1", "k2"])
        .groupBy("p1", "p2")
        .agg(
            F.first("doc_id").alias("next_doc_id"), F.first("k1").alias("n1"), F.first("k2").alias("n2"),
            F.first(F.substring("text", F.lit(1), F.floor(F.col("chars") / 4).cast("int"))).alias("head"),
        )
    )
    heads = heads.withColumnsRenamed({"p1": "k1", "p2": "k2"})
    length = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), (length - F.floor(length / 4)).cast("int")), "head")
    return texts.join(heads, ["k1", "k2"]).select(
        "doc_id", "k1", "k2", "next_doc_id", "n1", "n2", "text", edited.alias("edited_text")
    )


def fingerprinted(docs: DataFrame, size: int = WORDS_PER_SHINGLE) -> DataFrame:
    """doc_id, next_doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (binary), near_edited, near_next.

    Cases as in ``edited_texts``.
    """
    made = stored(
        edited_texts(docs).select(
            "doc_id", "k1", "k2", "next_doc_id", "n1", "n2",
            F.length("text").cast("long").alias("n_chars"),
            F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
            fingerprint(F.col("text"), size).alias("fingerprint"),
            fingerprint(F.col("edited_text"), size).alias("edited_fingerprint"),
        ),
        "fingerprints",
    )
    others = made.groupBy(F.col("k1").alias("n1"), F.col("k2").alias("n2")).agg(F.first("fingerprint").alias("other"))
    return (
        made.join(others, ["n1", "n2"])
        .withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint")))
        .withColumn("near_next", likeness(F.col("fingerprint"), F.col("other")))
        .drop("other", "k1", "k2", "n1", "n2")
    )
