import datetime

from frames import rows_of
from pyspark.sql import functions as F

from spelltally.functions.dates import in_period, parse_date, parse_date_trimmed
from spelltally.operators import postings
from spelltally.operators.spells import active_spells

POSTINGS = "job_id long, post_date string"


def month(text):
    return datetime.date.fromisoformat(text)


def test_monthly_counts(spark):
    rows = [
        (1, "2021-01-31"),
        (1, "2021-01-31"),
        (2, "2021-03-05"),
        (2, "2021-02-01"),  # earliest date decides
        (3, "unknown"),
        (4, None),
        (None, "2021-01-01"),
        (5, "2021-2-9"),
    ]
    frame = spark.createDataFrame(rows, POSTINGS)
    got = [tuple(r) for r in postings.monthly_counts(frame.repartition(3)).collect()]
    assert got == [(month("2021-01-01"), 1), (month("2021-02-01"), 2)]


def test_calendar_keeps_gaps_and_leaves_out_other_months(spark):
    monthly = spark.createDataFrame(
        [(month("2020-12-01"), 9), (month("2021-02-01"), 4)], "month date, posting_count long"
    )
    filled = postings.fill_calendar(monthly, ("2021-01-01", "2021-03-01"))
    assert [tuple(r) for r in filled.collect()] == [
        (month("2021-01-01"), None),
        (month("2021-02-01"), 4),
        (month("2021-03-01"), None),
    ]


def test_hot_job_id_is_collapsed_before_the_shuffle(spark):
    """Map tasks merge the rows of one job, so a hot id reaches the reducer once per task."""
    frame = spark.range(0, 10_000, 1, 4).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS job_id",
        "cast(date_add(date'2021-01-01', cast(id % 300 AS int)) AS string) AS post_date",
    )
    plan = postings.monthly_counts(frame)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min(post_date" in plan
    assert sum(r[1] for r in rows_of(postings.monthly_counts(frame))) == 6666


def test_years_bound_the_scan_and_change_no_row(spark, tmp_path):
    period = ("2021-01-01", "2022-12-31")
    texts = [
        "2020-12-31", "2021-1-1", "2021-01-01", "2022-12-31", "2022-2-30", "2022", "2022-12-31x",
        "2023-01-01", " 2021-05-05", "unknown", "", None, "20210505", "2021-05-05",
    ]
    spark.createDataFrame(list(enumerate(texts)), POSTINGS).write.parquet(str(tmp_path / "p"))
    frame = spark.read.parquet(str(tmp_path / "p"))
    kept = postings.posted_within(frame, period)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(post_date,2021)" in plan and "LessThan(post_date,2023)" in plan
    assert rows_of(kept) == rows_of(frame.where(in_period(parse_date(F.col("post_date")), period)))


def test_starts_bound_the_scan_of_spells(spark, tmp_path):
    rows = [("2021-12-31", None), ("2022-12-01", "bad"), ("2022-12-2", None), (" 2022-01-01", None), ("2023-01-01", None), (None, None)]
    spark.createDataFrame(rows, "startdate string, enddate string").write.parquet(str(tmp_path / "s"))
    frame = spark.read.parquet(str(tmp_path / "s"))
    strict, trimmed = (active_spells(frame, "2022-12-01", parse) for parse in (parse_date, parse_date_trimmed))
    plan = strict._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(startdate,2023)" in plan
    assert rows_of(strict) == [("2021-12-31", None)]
    assert rows_of(trimmed) == [(" 2022-01-01", None), ("2021-12-31", None)]


def test_both_monthly_series_from_one_pass(spark):
    rows = [(1, "2021-01-31", "Admin"), (1, "2021-03-01", "Engineer"), (2, "2021-02-01", None), (3, "bad", "Engineer"), (4, "2021-03-09", "Scientist")]
    frame = spark.createDataFrame(rows, "job_id long, post_date string, job_category string")
    focal = ("Scientist", "Engineer")
    both = postings.monthly_counts_both(frame, focal)
    for own, alone in ((False, frame), (True, frame.where(F.col("job_category").isin(*focal)))):
        assert rows_of(both.where(F.col("focal") == own).drop("focal")) == rows_of(postings.monthly_counts(alone))
