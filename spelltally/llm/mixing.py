"""Mixing sources to target weights by Pareto order sampling.

Sources get word targets by weight, none above ``cap`` times what it holds. Within a
source each size gets an expected number of copies. Whole copies are certain; the rest is
an inclusion probability, and a fixed number of documents per stratum is drawn by Pareto
order sampling: those with the smallest odds(u) / odds(inclusion), u being a hash of id
and text. Only counts and thresholds meet; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spelltally.llm.common import quoted, stored, whole, without, word_count

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 71
# Expected copies fall with size to this power, so that no few long texts fill a source.
TILT = 0.125
# Strata of a source: classes of size, so many for each doubling.
CLASSES = 4
BUCKETS = 64
# Expected copies this near to a whole number are that number.
NEAR = 1e-9


def waterfill(items: DataFrame, keys: list[str], weight: Column, cap: Column, total: Column) -> DataFrame:
    """Add ``allotted``: a share of ``total`` by weight, never above ``cap``; and ``level``, share by weight.

    What a cap cuts off goes to the others by weight, until none is above. Items are few:
    one row per source, or per source and size.
    """
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    order = group.orderBy("_ratio", "_cap", "_weight")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    free = F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    left = F.sum("_weight").over(group) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    return (
        items.withColumn("_weight", weight.cast("double"))
        .withColumn("_cap", cap.cast("double"))
        .withColumn("_total", total.cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_level", free / left)
        .withColumn("_open", F.when(F.col("_ratio") > F.col("_level"), F.col("_level")))
        .withColumn(
            "level",
            F.first("_open", ignorenulls=True).over(
                order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
        )
        .withColumn(
            "allotted", F.coalesce(F.least("_cap", F.col("_weight") * F.col("level")), F.col("_cap"))
        )
        .drop("_weight", "_cap", "_total", "_ratio", "_level", "_open")
    )


def _sized(docs: DataFrame) -> DataFrame:
    """``_size`` in words and ``_u`` in (0, 1), drawn by hash from id and text."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", whole()), 12)
    return docs.withColumn("_size", word_count(whole())).withColumn("_u", (bits + F.lit(0.5)) / F.lit(2.0**52))


def _joined(left: DataFrame, right: DataFrame, *also: str) -> DataFrame:
    """Left join on the source, null equal to null, and on further columns."""
    right = right.withColumnRenamed("source", "_its_source")
    condition = left["source"].eqNullSafe(right["_its_source"])
    for name in also:
        right = right.withColumnRenamed(name, f"_its{name}")
        condition = condition & (left[name] == right[f"_its{name}"])
    return left.join(right, condition, "left").drop("_its_source", *(f"_its{name}" for name in also))


def targets(sized: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per source: its words and its target. Weights repeat over sources by code point."""
    sums = sized.groupBy("source").agg(F.sum("_size").alias("_source_size"))
    ordered = sums.withColumn(
        "_place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    ).withColumn("_total_size", F.sum("_source_size").over(Window.partitionBy(F.lit(0))))
    by_place = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_place") - 1) % len(weights) + 1).cast("int"))
    return waterfill(
        ordered, [], by_place, F.col("_source_size") * F.lit(cap), F.col("_total_size")
    ).select("source", "_source_size", F.col("allotted").alias("_target"))


def levels(sized: DataFrame, goals: DataFrame, cap: float = CAP) -> DataFrame:
    """The goals with ``_level``: a text of ``w`` words is due least(cap, level * w ** -TILT) copies."""
    sizes = sized.where("_size > 0").groupBy("source", "_size").agg(F.count(F.lit(1)).alias("_docs"))
    words = F.col("_size") * F.col("_docs")
    shared = waterfill(
        _joined(sizes, goals.select("source", "_target")),
        ["source"],
        words * F.pow("_size", F.lit(-TILT)),
        words * F.lit(cap),
        F.col("_target"),
    )
    return _joined(goals, shared.groupBy("source").agg(F.max("level").alias("_level")))


def _due(docs: DataFrame, plan: DataFrame, cap: float) -> DataFrame:
    """Add the plan's columns, ``_certain`` copies and the ``_chance`` of one more."""
    due = F.coalesce(F.least(F.lit(float(cap)), F.col("_level") * F.pow("_size", F.lit(-TILT))), F.lit(float(cap)))
    due = F.when(F.col("_size") > 0, due).otherwise(0.0)
    rest = F.col("_due") - F.col("_certain")
    return (
        _joined(docs, plan)
        .withColumn("_due", due)
        .withColumn("_certain", F.floor(F.col("_due") + NEAR))
        .withColumn("_chance", F.when(rest > NEAR, rest).otherwise(0.0))
        .withColumn("_stratum", F.when(F.col("_size") > 0, F.floor(F.log2("_size") * CLASSES).cast("int")))
        .drop("_due", "_level")
    )


def quotas(drawn: DataFrame) -> DataFrame:
    """How many documents each stratum adds beyond its certain copies.

    From the longest texts down, each stratum takes as many as come nearest to the words
    due so far, so what rounding leaves over is passed on to shorter texts.
    """
    strata = (
        drawn.groupBy("source", "_stratum", "_size", "_chance")
        .agg(F.count(F.lit(1)).alias("_docs"))
        .groupBy("source", "_stratum")
        .agg(
            F.sum("_docs").alias("docs"),
            F.sum(F.col("_chance") * F.col("_docs")).alias("due"),
            F.sum(F.col("_chance") * F.col("_docs") * F.col("_size")).alias("words"),
        )
    )
    # A source has at most CLASSES strata for each bit of a size.
    per_source = strata.groupBy("source").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("_stratum", "docs", "due", "words")))).alias("strata")
    )
    taken = "cast(least(s.docs, greatest(0, round((acc.due + s.words) / (s.words / s.due)))) AS bigint)"
    return per_source.select(
        "source",
        F.explode(
            F.expr(
                f"""aggregate(strata,
                    named_struct('due', 0D, 'quotas', CAST(array() AS array<struct<_stratum:int,_quota:bigint>>)),
                    (acc, s) -> named_struct(
                        'due', acc.due + s.words - {taken} * (s.words / s.due),
                        'quotas', concat(acc.quotas, array(named_struct('_stratum', s._stratum, '_quota', {taken})))),
                    acc -> acc.quotas)"""
            )
        ).alias("q"),
    ).select("source", "q.*")


def _ranked(docs: DataFrame) -> DataFrame:
    """Pareto rank ``_rank`` = odds(u) / odds(inclusion), and ``_bucket``, monotone in it."""
    odds = F.col("_u") / (1 - F.col("_u"))
    rank = odds * (1 - F.col("_chance")) / F.col("_chance")
    return docs.withColumn("_rank", F.when(F.col("_chance") > 0, rank)).withColumn(
        "_bucket",
        F.when(F.col("_rank").isNotNull(), F.least(F.lit(BUCKETS - 1), F.floor(F.col("_rank") / (1 + F.col("_rank")) * BUCKETS)).cast("int")),
    )


def thresholds(sized: DataFrame, plan: DataFrame, cap: float = CAP) -> DataFrame:
    """Per stratum the largest Pareto rank that is still taken.

    Counts per bucket of rank show which bucket holds it; only that bucket is ordered.
    """
    drawn = _ranked(_due(sized, plan, cap)).where("_chance > 0")
    counts = drawn.groupBy("source", "_stratum", "_bucket").agg(F.count(F.lit(1)).alias("_in"))
    upto = F.sum("_in").over(Window.partitionBy("source", "_stratum").orderBy("_bucket"))
    edges = (
        _joined(counts.withColumn("_upto", upto), quotas(drawn), "_stratum")
        .where("_quota > 0 AND _upto >= _quota AND _upto - _in < _quota")
        .select("source", "_stratum", "_bucket", (F.col("_quota") - F.col("_upto") + F.col("_in")).alias("_place"))
    )
    place = F.row_number().over(Window.partitionBy("source", "_stratum", "_bucket").orderBy("_rank"))
    return (
        _joined(drawn.select("source", "_stratum", "_bucket", "_rank"), edges, "_stratum", "_bucket")
        .where("_place IS NOT NULL")
        .withColumn("_at", place)
        .where("_at = _place")
        .select("source", "_stratum", F.col("_rank").alias("_limit"))
    )


def _planned(docs: DataFrame, weights, cap: float) -> DataFrame:
    docs = _sized(docs)
    sized = stored(docs.select("source", "_size", "_u"), "mix-sizes")
    plan = stored(levels(sized, targets(sized, weights, cap), cap), "mix-plan")
    limits = stored(thresholds(sized, plan, cap), "mix-limits")
    rows = _joined(_ranked(_due(docs, plan, cap)), limits, "_stratum")
    extra = F.coalesce((F.col("_rank") <= F.col("_limit")).cast("int"), F.lit(0))
    return rows.withColumn("_copies", (F.col("_certain") + extra).cast("int"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` (its source's), ``copies`` and ``taken`` (words).

    Needs ``doc_id``, ``text`` and ``source``; columns named like a result are replaced. A
    null text has size 0 and no copies; a null source is a source, the last one. Rows with
    equal id and text share their fate. An empty input gives an empty result.
    """
    kept = without(docs, "size", "source_size", "target", "copies", "taken")
    return _planned(kept, weights, cap).select(
        *(quoted(name) for name in kept.columns),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def mixed_rows(docs: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns only."""
    copies = _planned(docs, weights, cap).where("_copies > 0")
    return copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(
        *(quoted(name) for name in docs.columns)
    )
