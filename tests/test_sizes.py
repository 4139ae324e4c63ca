import math
import random

import pandas as pd
import pytest

from spelltally.operators import sizes


def counts(spark, values):
    rows = list(enumerate(values))
    return spark.createDataFrame(rows, "rcid long, n long")


def table(spark, values):
    return sizes.size_table(counts(spark, values), "n")


SAMPLES = {n: [random.Random(n).randint(1, max(2, n)) for _ in range(n)] for n in (1, 2, 3, 39, 40, 41, 80, 120)}
SAMPLES["ties"] = [1] * 30 + [7] * 10
SAMPLES["zeros"] = [0] * 50 + [3, 4, 4, 9]
SAMPLES["hot"] = [5] * 900 + list(range(1, 101))


@pytest.mark.parametrize("name", SAMPLES)
def test_cutoff_and_histogram_against_pandas(spark, name):
    values = pd.Series([v for v in SAMPLES[name] if v > 0])
    cutoff = int(values.quantile(0.975, interpolation="higher"))
    row = sizes.truncation(table(spark, SAMPLES[name]), "n", 0.975).first()
    assert tuple(row) == (cutoff, len(values), int((values > cutoff).sum()))
    shown = values[values <= cutoff].value_counts().sort_index()
    histogram = sizes.truncated_histogram(table(spark, SAMPLES[name]), "n", 0.975).collect()
    assert [tuple(r) for r in histogram] == list(shown.items())


@pytest.mark.parametrize("name", SAMPLES)
def test_description_against_pandas(spark, name):
    values = pd.Series([v for v in SAMPLES[name] if v > 0])
    row = sizes.size_description(table(spark, SAMPLES[name]), "n").first()
    expected = values.describe()
    assert row["company_count"] == expected["count"]
    assert row["mean"] == pytest.approx(expected["mean"], rel=1e-12)
    if len(values) == 1:
        assert row["standard_deviation"] is None
    else:
        assert row["standard_deviation"] == pytest.approx(expected["std"], rel=1e-12)
    assert (row["minimum"], row["maximum"]) == (expected["min"], expected["max"])
    for label, quantile in (("p25", "25%"), ("p50", "50%"), ("p75", "75%")):
        assert row[label] == pytest.approx(expected[quantile], rel=1e-12)
    statistics = sizes.size_statistics(table(spark, SAMPLES[name]), "n").first()
    assert statistics["median"] == statistics["p50"] == row["p50"]


def test_no_positive_firm(spark):
    assert tuple(sizes.truncation(table(spark, [0, 0]), "n", 0.975).first())[:1] == (None,)
    assert sizes.truncated_histogram(table(spark, [0, 0]), "n", 0.975).count() == 0
    assert sizes.size_description(table(spark, [0]), "n").first()["mean"] is None


def test_deviation_keeps_digits_of_large_counts(spark):
    values = [10**9, 10**9 + 1, 10**9 + 2]
    row = sizes.size_description(table(spark, values), "n").first()
    assert math.isclose(row["standard_deviation"], 1.0, rel_tol=1e-9)
