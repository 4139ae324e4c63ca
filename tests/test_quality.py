import pytest
from frames import rows_of
from pyspark.sql import functions as F

from spelltally.functions.dates import parse_date, parse_date_trimmed
from spelltally.operators import quality, samples, spells
from spelltally.plans import passes


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "k long")


def test_check_key(spark):
    assert rows_of(quality.check_key(ids(spark, [1, 2, 3]), "k", "t.k")) == [
        ("key_not_null", "t.k", 0, True),
        ("key_unique", "t.k", 0, True),
    ]
    assert rows_of(quality.check_key(ids(spark, [1, 1, 1, None, None]), "k", "t.k")) == [
        ("key_not_null", "t.k", 2, False),
        ("key_unique", "t.k", 3, False),
    ]
    assert rows_of(quality.check_key(ids(spark, []), "k", "t.k")) == [
        ("key_not_null", "t.k", 0, True),
        ("key_unique", "t.k", 0, True),
    ]


def test_check_key_of_two_columns(spark):
    frame = spark.createDataFrame([(1, 1), (1, 2), (1, None), (1, 2)], "a long, b long")
    assert [r[2] for r in rows_of(quality.check_key(frame, ("a", "b"), "t"))] == [1, 1]


def test_check_nonnegative(spark):
    assert rows_of(quality.check_nonnegative(ids(spark, [0, 5]), "k", "k"))[0][2:] == (0, True)
    assert rows_of(quality.check_nonnegative(ids(spark, [0, -5]), "k", "k"))[0][2:] == (1, False)


def test_check_one_to_one(spark):
    report = quality.check_one_to_one(ids(spark, [1, 2]), ids(spark, [1, 1]), "k", ("l", "r"))
    assert rows_of(report) == [("one_to_one", "l", 0, True), ("one_to_one", "r", 1, False)]


def test_check_same_universe_looks_both_ways(spark):
    report = quality.check_same_universe(
        ids(spark, [1, 2]), ids(spark, [2, 3, 4]), "k", ("l", "r")
    )
    assert rows_of(report) == [("same_universe", "l", 2, False), ("same_universe", "r", 1, False)]


def test_check_group_sum(spark):
    groups = spark.createDataFrame([("a", 2), ("b", 1)], "g string, n long")
    fits = quality.check_group_sum(groups, "n", ids(spark, [1, 2, 3]), "s")
    fails = quality.check_group_sum(groups, "n", ids(spark, [1]), "s")
    assert rows_of(fits) == [("group_sum", "s", 0, True)]
    assert rows_of(fails) == [("group_sum", "s", 2, False)]


def test_check_group_sums(spark):
    frame = spark.createDataFrame(
        [(1, "a", True), (2, "a", False), (3, "b", True), (None, "b", True)],
        "k long, g string, held boolean",
    )
    groupings = {"all": F.col("k").isNotNull(), "held": F.col("held"), "none": F.lit(False)}
    report = quality.check_group_sums(frame, "k", "g", groupings)
    # The null key is a member that no group counts.
    assert rows_of(report) == [
        ("group_sum", "all", 0, True),
        ("group_sum", "held", 1, False),
        ("group_sum", "none", 0, True),
    ]
    members = spark.range(5).selectExpr("id AS k", "id % 2 AS g")
    plan = quality.check_group_sums(members, "k", "g", {"all": F.lit(True)})
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_enforce(spark):
    quality.enforce(quality.check_key(ids(spark, [1]), "k", "t.k"))
    with pytest.raises(ValueError, match="key_unique of t.k: 1 violations"):
        quality.enforce(quality.check_key(ids(spark, [1, 1]), "k", "t.k"))


def test_date_diagnostics(spark):
    rows = [("2022-01-01", None), (" 2022-01-01", "  "), ("bad", None), (None, None), ("", "\t")]
    frame = spark.createDataFrame(rows, "s string, e string")
    assert rows_of(quality.date_diagnostics(frame, "d", "s", "e")) == [
        ("d", "e", 5, 5, 0, 0, 0.0),
        ("d", "s", 5, 2, 3, 2, 2 / 3),
    ]
    trimmed = quality.date_diagnostics(frame, "d", "s", parse=parse_date_trimmed)
    assert rows_of(trimmed) == [("d", "s", 5, 2, 3, 1, 1 / 3)]
    assert rows_of(quality.date_report(trimmed)) == [("d", "s", 3, 1, 1 / 3 * 100)]
    assert rows_of(quality.date_diagnostics(frame.limit(0), "d", "s")) == [
        ("d", "s", 0, 0, 0, 0, 0.0)
    ]


def test_a_pass_reads_each_date_once(spark):
    texts = ["2020-01-31", " 2020-01-31", "2020-01-31\t", "2020-02-31", " 2020-02-31 ", "9999-12-31", "unknown", "  ", "", None]
    frame = spark.createDataFrame([(a, b) for a in texts for b in texts], "startdate string, enddate string")
    read = passes.with_dates(frame, "startdate", "enddate", trimmed=True)
    for name in ("startdate", "enddate"):
        for reading, parse in passes.READINGS.items():
            assert read.where(~F.col(passes.read_as(name, reading)).eqNullSafe(parse(F.col(name)))).count() == 0
    by = tuple(passes.read_as(name, passes.TRIMMED) for name in ("startdate", "enddate"))
    watched, _ = quality.dates_in_passing(read, "d", "startdate", "enddate", readings=passes.READINGS, read=passes.read_as)
    running = spells.active_spells(watched, "2020-02-15", parse_date_trimmed, by)
    assert running._jdf.queryExecution().executedPlan().toString().count("regexp_extract(") == 4
    wanted = spells.active_spells(frame, "2020-02-15", parse_date_trimmed)
    made = running.select(*frame.columns)
    assert made.exceptAll(wanted).count() == 0 and wanted.exceptAll(made).count() == 0
    assert made.count() > 0


def test_dates_in_passing_of_an_empty_frame(spark, tmp_path):
    frame = spark.createDataFrame([], "s string")
    watched, dates = quality.dates_in_passing(frame, "d", "s", readings={"": parse_date})
    watched.write.parquet(str(tmp_path / "none"))
    assert rows_of(dates()) == [("", "d", "s", 0, 0, 0, 0, 0.0)]


def test_profile_table(spark):
    frame = spark.createDataFrame([(1, "a"), (1, None), (None, None)], "k long, v string")
    assert rows_of(quality.profile_table(frame, "t", ("k",))) == sorted(
        [
            ("t", "*", None, "row_count", 3),
            ("t", "k", "bigint", "null_count", 1),
            ("t", "v", "string", "null_count", 2),
            ("t", "k", None, "key_null_rows", 1),
            ("t", "k", None, "key_surplus_rows", 1),
        ],
        key=repr,
    )


def test_samples(spark):
    frame = spark.range(100).selectExpr("id", "CASE WHEN id % 2 = 0 THEN id END AS half")
    assert samples.first_rows(frame, 10).count() == 10
    drawn = rows_of(samples.hashed_rows(frame, 10, 1))
    assert drawn == rows_of(samples.hashed_rows(frame.repartition(7), 10, 1))
    assert drawn != rows_of(samples.hashed_rows(frame, 10, 2))
    assert len(rows_of(samples.hashed_rows(frame, 1000, 1))) == 100


def test_draws_of_a_large_table(spark):
    """A bound on the digest ranks few rows and changes none; with few keys all rows are ranked."""
    frame = spark.range(20_000).selectExpr("id", "id % 3 AS third", "id % 7 AS x")
    for key in (("id",), ("third",), ()):
        drawn = rows_of(samples.hashed_rows(frame, 50, 3, key))
        digest = samples._digest(list(key or frame.columns), 3)
        assert drawn == rows_of(frame.orderBy(digest, samples._digest(frame.columns, 3)).limit(50))
        assert drawn == rows_of(samples.hashed_rows(frame.repartition(9, "x"), 50, 3, key))


def test_digest_tells_rows_apart(spark):
    rows = [(None, "a"), ("~", "a"), ("a|b", "c"), ("a", "b|c"), ("", "a"), ("-", "a")]
    frame = spark.createDataFrame(rows, "x string, y string")
    draws = [samples.hashed_rows(frame.repartition(n, "y"), 3, 1).collect() for n in (1, 2, 5)]
    assert draws[0] == draws[1] == draws[2]
