import datetime

import pytest
from pyspark.sql import functions as F

from spelltally.functions import dates, numbers, text


def evaluate(spark, values, function, schema="v string"):
    frame = spark.createDataFrame([(v,) for v in values], schema)
    return [row[0] for row in frame.select(function(F.col("v"))).collect()]


def day(value):
    return datetime.date.fromisoformat(value)


DATES = {
    "2022-12-01": "2022-12-01",
    "2022-1-5": "2022-01-05",
    "2022-01-5": "2022-01-05",
    "0022-01-05": None,
    "2022-12": None,
    "2022": None,
    "2022-02-30": None,
    "2022-13-01": None,
    "2022-00-10": None,
    "2022-012-01": None,
    "20221201": None,
    "2022-12-01 00:00:00": None,
    "2022-12-01T00": None,
    "+2022-12-01": None,
    "2022-12-01\n": None,
    "9999-12-31": None,
    "1677-09-21": None,
    "1677-09-22": "1677-09-22",
    "1677-9-30": "1677-09-30",
    "1677-10-01": "1677-10-01",
    "1677-08-30": None,
    "1678-01-01": "1678-01-01",
    "1699-01-01": "1699-01-01",
    "1900-02-28": "1900-02-28",
    "2000-02-29": "2000-02-29",
    "2199-12-31": "2199-12-31",
    "2259-12-31": "2259-12-31",
    "2261-12-31": "2261-12-31",
    "2262-04-11": "2262-04-11",
    "2262-4-1": "2262-04-01",
    "2262-04-12": None,
    "2262-05-01": None,
    "2263-01-01": None,
    "unknown": None,
    "": None,
    "   ": None,
    "\t": None,
    None: None,
}


def test_parse_date(spark):
    got = evaluate(spark, list(DATES), dates.parse_date)
    assert got == [v and day(v) for v in DATES.values()]


def test_parse_date_covers_every_year_of_the_range(spark):
    years = list(range(1600, 2400))
    got = evaluate(spark, [f"{y}-06-15" for y in years], dates.parse_date)
    assert [d is not None for d in got] == [1678 <= y <= 2261 for y in years]


def test_parse_date_rejects_padding_and_trimmed_accepts_it(spark):
    padded = [" 2022-12-01", "2022-12-01 ", "\t2022-12-01 \n", "　2022-12-01", " 2022-12", "  "]
    assert evaluate(spark, padded, dates.parse_date) == [None] * 6
    expected = [day("2022-12-01")] * 4 + [None, None]
    assert evaluate(spark, padded, dates.parse_date_trimmed) == expected


def test_strip_removes_what_python_removes(spark):
    values = [" a b ", "\ta ", " x　", "\x1cq\x1f", "", "  ", "line\nbreak ", "a"]
    assert evaluate(spark, values, text.strip) == [v.strip() for v in values]
    assert evaluate(spark, [None], text.strip) == [None]


def test_has_text(spark):
    values = [None, "", " ", "\t", " ", "\x1d", " x ", "NA", "0"]
    assert evaluate(spark, values, text.has_text) == [v is not None and v.strip() != "" for v in values]


def test_label_or_missing(spark):
    values = [None, "", "   ", "\t", " ", "  Peru ", "NA", "a\nb", "Missing"]
    assert evaluate(spark, values, text.label_or_missing) == [
        "Missing", "Missing", "Missing", "Missing", "Missing", "Peru", "NA", "a\nb", "Missing",
    ]


@pytest.mark.parametrize(
    "start, end, running",
    [
        ("2022-12-01", None, True),
        ("2022-12-02", None, False),
        ("2020-01-01", "2022-12-01", True),
        ("2020-01-01", "2022-11-30", False),
        ("2020-01-01", "", True),
        ("2020-01-01", " \t", True),
        ("2020-01-01", "unknown", False),
        ("2020-01-01", " 2023-01-01", False),
        ("2020-01-01", "9999-12-31", False),
        (" 2020-01-01", None, False),
        ("unknown", None, False),
        (None, None, False),
        ("", None, False),
    ],
)
def test_active_at(spark, start, end, running):
    frame = spark.createDataFrame([(start, end)], "s string, e string")
    kept = frame.where(dates.active_at(F.col("s"), F.col("e"), "2022-12-01")).count()
    assert bool(kept) is running


def test_active_at_trimmed_reads_padded_dates(spark):
    frame = spark.createDataFrame([(" 2020-01-01", "2023-01-01 ")], "s string, e string")
    active = dates.active_at(F.col("s"), F.col("e"), "2022-12-01", dates.parse_date_trimmed)
    assert frame.where(active).count() == 1


def test_in_period_includes_both_ends(spark):
    values = ["2020-12-31", "2021-01-01", "2022-12-31", "2023-01-01"]
    got = evaluate(
        spark, values, lambda c: dates.in_period(c.cast("date"), ("2021-01-01", "2022-12-31"))
    )
    assert got == [False, True, True, False]


def test_months(spark):
    months = spark.range(1).select(F.explode(dates.month_range("2018-01-01", "2025-05-01"))).collect()
    assert len(months) == 89
    assert months[0][0] == day("2018-01-01") and months[-1][0] == day("2025-05-01")
    assert evaluate(spark, ["2022-02-28"], lambda c: dates.month_start(c.cast("date"))) == [
        day("2022-02-01")
    ]


def test_ratios(spark):
    frame = spark.createDataFrame([(1, 4), (0, 0), (None, 3)], "a long, b long")
    a, b = F.col("a"), F.col("b")
    assert [r[0] for r in frame.select(numbers.ratio_or_zero(a, b)).collect()] == [0.25, 0.0, 0.0]
    assert [r[0] for r in frame.select(numbers.ratio_or_null(a, b)).collect()] == [0.25, None, None]
    assert [r[0] for r in frame.select(numbers.zero_if_null(a)).collect()] == [1, 0, 0]
    assert frame.select(numbers.percent(F.lit(0.25))).first()[0] == 25.0
