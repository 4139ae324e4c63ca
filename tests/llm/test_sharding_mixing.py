import zlib

import numpy as np
import pytest
from llm_cases import ODD

from spelltally.llm import mixing, sharding


@pytest.mark.parametrize("total", [1, 2, 3, 10, 1000, 1024, 1025])
def test_permutation_is_a_bijection_with_an_inverse(total):
    numbers = np.arange(total)
    moved = sharding.permute(numbers, total)
    assert sorted(moved) == list(numbers)
    assert (sharding.permute(moved, total, inverse=True) == numbers).all()


def test_row_at_finds_the_row_of_a_slot(spark):
    rows = sharding.shard(spark.range(100).toDF("doc_id"), 7).collect()
    for row in rows:
        assert sharding.row_at(row["shard"], row["slot"], 7, 100) == row["row_number"]


def test_shards_do_not_depend_on_partitions(spark):
    rows = spark.range(300).selectExpr("id AS doc_id", "id % 3 AS other")
    a = sharding.shard(rows, 5).toPandas().sort_values("doc_id", ignore_index=True)
    b = sharding.shard(rows.repartition(7), 5).toPandas().sort_values("doc_id", ignore_index=True)
    assert a.equals(b)


def test_repeated_rows_get_numbers_of_their_own(spark):
    rows = spark.range(25).selectExpr("1 AS doc_id")
    numbers = sharding.numbered(rows, copies_at_once=4).toPandas()["row_number"]
    assert sorted(numbers) == list(range(25))


def test_shard_odd_rows(odd, empty):
    rows = sharding.shard(odd, 3).toPandas()
    assert len(rows) == len(ODD) and list(rows.columns)[:5] == odd.columns
    for _, part in rows.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert sharding.shard(empty, 3).count() == 0


def test_shard_query(provided, documents):
    rows = provided("op1_shard_documents").sort_values("doc_id", ignore_index=True)
    assert list(rows["size"]) == [len(t.encode()) + 16 for t in documents["text"]]
    assert list(rows["text_crc32"]) == [zlib.crc32(t.encode()) for t in documents["text"]]
    sizes = rows.groupby("shard").size()
    assert len(sizes) == 40 and sizes.max() - sizes.min() <= 1


def refilled(sizes, weights, cap):
    """Targets by resharing the excess until none is above its cap."""
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(cap * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        out = [cap * s if i in capped else rest * weights[i] / weight for i, s in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in capped and out[i] > cap * sizes[i] + 1e-9}
        if not over:
            return out
        capped |= over


def test_targets_are_refilled(spark):
    sizes = [5, 400, 10, 0, 100, 30]
    rows = [(i, " ".join(["w"] * n), chr(97 + i)) for i, n in enumerate(sizes)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    wanted = refilled(sizes, [1, 2, 3, 1, 2, 3], 3)
    assert list(mixed.sort_values("doc_id")["target"]) == pytest.approx(wanted)


def test_mix_query_meets_targets(provided):
    rows = provided("op5_mix_sources")
    assert (rows["taken"] <= 3 * rows["size"]).all() and (rows["taken"] % rows["size"].clip(lower=1) == 0).all()
    by = rows.groupby("source").agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["own"]).all()
    wanted = refilled(list(by["size"]), [1 + i % 3 for i in range(len(by))], 3)
    assert list(by["target"]) == pytest.approx(wanted)
    assert abs(by["taken"].sum() / by["target"].sum() - 1) < 0.05


def test_mix_odd_rows(odd, empty):
    rows = mixing.mix(odd).toPandas()
    assert len(rows) == len(ODD) and rows["target"].notna().all()
    assert (rows["taken"][rows["text"].isna()] == 0).all()
    assert mixing.mixed_rows(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0
