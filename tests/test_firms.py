import pytest
from frames import MemoryTables, rows_of
from pyspark.sql import functions as F

from spelltally.config import BIOPHARM
from spelltally.operators import bitmaps
from spelltally.operators import firms as firm_ops
from spelltally.operators.dedup import one_row_per_key, smallest_per_key
from spelltally.operators.firms import FirmUniverse
from spelltally.plans import checks, extraction, firms, monthly, passes, roles

PHARMA = "Pharmaceuticals"
COMPANIES = [
    (1, "One", "Peru", "k", PHARMA),
    (2, "Two", None, "k", PHARMA),
    (3, "Three", "  ", "k", "Pharmaceutical Manufacturing"),
    (4, "Four", " Peru ", "k", PHARMA),
    (5, "Other", "Peru", "k", "Retail"),
    (6, "None", "Chile", "k", None),
    (4, "Four again", "Chad", "k", PHARMA),
]
POSITIONS = [
    # position, user, firm, start, end, category, role
    (1, 10, 1, "2020-01-01", None, "Scientist", "biologist"),
    (2, 10, 1, "2021-01-01", " ", "Engineer", "tester"),
    (3, 11, 1, "2020-01-01", "2022-12-01", "Admin", "clerk"),
    (4, 12, 1, "2020-01-01", "2022-11-30", "Scientist", "biologist"),
    (5, None, 1, "2020-01-01", None, "Scientist", None),
    (6, 13, 2, "2020-01-01", "bad", "Scientist", "biologist"),
    (7, 14, 4, "2019-05-05", None, "Engineer", "  "),
    (8, 15, 5, "2019-05-05", None, "Engineer", "tester"),
    (9, 16, None, "2019-05-05", None, "Engineer", "tester"),
    (10, None, 3, "2019-05-05", None, "Engineer", "tester"),
]
LINKEDIN = [
    (100, 1, "2021-01-01", "Scientist"),
    (100, 4, "2022-12-31", "Engineer"),
    (101, 1, "2020-12-31", "Scientist"),
    (None, 1, "2021-06-01", "Scientist"),
    (102, None, "2021-06-01", "Scientist"),
    (103, 5, "2021-06-01", "Scientist"),
    (104, 2, " 2021-06-01", "Admin"),
]
INDEED = [
    (100, 4, "2021-03-01", "Engineer"),
    (105, 4, "2021-04-01", "Admin"),
    (105, 4, "2021-04-01", "Admin"),
]


def tables(spark, **options):
    return MemoryTables(
        spark,
        {
            "company_ref": COMPANIES,
            "user_positions": POSITIONS,
            "postings_linkedin": LINKEDIN,
            "postings_indeed": INDEED,
        },
        **options,
    )


def test_one_row_per_company_by_country_then_other_columns(spark):
    kept = rows_of(extraction.companies(tables(spark), BIOPHARM))
    assert kept == sorted(
        [COMPANIES[0], COMPANIES[1], COMPANIES[2], COMPANIES[3]], key=repr
    )


def test_universe_agrees_with_the_full_company_rows(spark):
    firms_seen = rows_of(extraction.universe(tables(spark), BIOPHARM).firms)
    assert firms_seen == [(1, "Peru"), (2, "Missing"), (3, "Missing"), (4, "Peru")]


def test_one_row_per_key_prefers_null_and_does_not_hang_on_partitions(spark):
    rows = [(1, "b", 2), (1, None, 3), (1, "a", 1), (2, "x", None), (2, "x", 0)]
    frame = spark.createDataFrame(rows, "k long, a string, b long")
    for parts in (1, 7):
        assert rows_of(one_row_per_key(frame.repartition(parts), "k")) == sorted(
            [(1, None, 3), (2, "x", None)], key=repr
        )


def test_smallest_per_key(spark):
    frame = spark.createDataFrame([("a", 3), ("a", 1), (None, 5), (None, 4)], "k string, v long")
    assert rows_of(smallest_per_key(frame, ["k"], "v")) == sorted([("a", 1), (None, 4)], key=repr)


def test_employee_counts_keep_firms_without_employees(spark):
    counts = rows_of(firms.firm_employee_counts(tables(spark), BIOPHARM))
    assert counts == [(1, "Peru", 2), (2, "Missing", 0), (3, "Missing", 0), (4, "Peru", 1)]


def test_focal_counts(spark):
    counts = rows_of(firms.firm_focal_counts(tables(spark), BIOPHARM))
    assert counts == [(1, "Peru", 1), (2, "Missing", 0), (3, "Missing", 0), (4, "Peru", 1)]


def test_one_pass_gives_what_two_give(spark):
    given = tables(spark)
    universe = extraction.universe(given, BIOPHARM)
    both = firms.firm_and_focal_counts(given, BIOPHARM, universe)
    assert rows_of(both.drop("focal_employee_count")) == rows_of(firms.firm_employee_counts(given, BIOPHARM))
    assert rows_of(both.drop("employee_count")) == rows_of(firms.firm_focal_counts(given, BIOPHARM))


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_dates_are_diagnosed_in_passing(spark, tmp_path, few):
    """With ids sent out and with ids joined by shuffle; what was kept gives the same results."""
    given = tables(spark)
    universe = extraction.universe(given, BIOPHARM)
    universe.broadcast_rows = few
    spells, dates = passes.spells_pass(given, BIOPHARM, universe, f"{tmp_path}/spells")
    for reading, trimmed in ((passes.STRICT, False), (passes.TRIMMED, True)):
        alone = checks.position_dates(given, BIOPHARM, trimmed)
        assert rows_of(dates.where(F.col("reading") == reading).drop("reading")) == rows_of(alone)
    kept, boards = {"user_positions": spells}, []
    for board in firms.BOARDS.values():
        kept[board], found = passes.postings_pass(given, board, universe, f"{tmp_path}/{board}")
        boards += rows_of(found)
    assert sorted(boards, key=repr) == rows_of(checks.posting_dates(given, BIOPHARM))
    passed = passes.PassedTables(kept)
    own = FirmUniverse(universe.firms, universe.ids, extracted=True)
    for plan in (firms.firm_employee_counts, firms.firm_focal_counts, firms.firm_posting_counts):
        assert rows_of(plan(passed, BIOPHARM, own)) == rows_of(plan(given, BIOPHARM))
    assert rows_of(roles.pair_summary(passed, BIOPHARM, own)) == rows_of(roles.pair_summary(given, BIOPHARM))
    for board in firms.BOARDS.values():
        both = monthly.monthly_postings_both(passed, BIOPHARM, board, own)
        assert rows_of(both) == rows_of(monthly.monthly_postings_both(given, BIOPHARM, board, universe))


def test_posting_keys(spark):
    # Job 100 is on both boards; on LinkedIn under firms 1 and 4, so it goes to firm 1.
    keys = rows_of(firms.posting_keys(tables(spark), BIOPHARM))
    assert keys == [("Indeed", 100, 4), ("Indeed", 105, 4), ("LinkedIn", 100, 1)]


def test_blank_job_id_text_is_counted(spark):
    class TextIds(MemoryTables):
        def frame(self, name, *columns):
            if name.startswith("postings"):
                rows = [("", 1, "2021-05-05", "Admin"), (" ", 1, "2021-05-05", "Admin"), (None, 1, "2021-05-05", "Admin")]
                table = self.spark.createDataFrame(
                    rows, "job_id string, rcid long, post_date string, job_category string"
                )
                return table.select(*columns) if columns else table
            return super().frame(name, *columns)

    keys = firms.posting_keys(TextIds(spark, {"company_ref": COMPANIES}), BIOPHARM)
    assert rows_of(keys.where("source = 'Indeed'")) == [("Indeed", " ", 1), ("Indeed", "", 1)]


def test_active_firms_and_countries(spark):
    active = rows_of(firms.active_firms(tables(spark), BIOPHARM))
    assert active == [
        (1, "Peru", 2, 1, True),
        (2, "Missing", 0, 0, False),
        (3, "Missing", 0, 0, False),
        (4, "Peru", 1, 2, True),
    ]
    assert rows_of(firms.active_by_country(tables(spark), BIOPHARM)) == [("Peru", 2)]
    assert [tuple(r) for r in firms.companies_by_country(tables(spark), BIOPHARM).collect()] == [
        ("Missing", 2),
        ("Peru", 2),
    ]


def test_largest_groups_come_in_rising_order(spark):
    groups = spark.createDataFrame(
        [("a", 5), ("b", 9), ("c", 5), ("d", 1)], "hq_country string, company_count long"
    )
    assert [tuple(r) for r in firm_ops.largest(groups, 3).collect()] == [
        ("c", 5), ("a", 5), ("b", 9),
    ]


PLANS = {
    "active_user_firms": firms.active_user_firms,
    "firm_employee_counts": firms.firm_employee_counts,
    "firm_focal_counts": firms.firm_focal_counts,
    "firm_posting_counts": firms.firm_posting_counts,
    "active_firms": firms.active_firms,
    "primary_roles": roles.primary_roles,
    "overlap_counts": roles.overlap_counts,
    "role_selection_diagnostics": roles.role_selection_diagnostics,
    "role_composition": roles.role_composition,
    "extract_summary": extraction.extract_summary,
    "position_dates": checks.position_dates,
    "posting_dates": checks.posting_dates,
    "monthly": lambda t, s: monthly.monthly_postings(t, s, "postings_linkedin"),
    "positions": lambda t, s: extraction.focal_facts(t, s, "user_positions"),
}


@pytest.mark.parametrize("name", PLANS)
def test_large_universe_and_extracts_give_the_same_result(spark, monkeypatch, name):
    plan = PLANS[name]
    broadcast = rows_of(plan(tables(spark), BIOPHARM))

    def extract(table):
        rows = tables(spark).frame(table)
        ids = extraction.universe(tables(spark), BIOPHARM).ids
        return [tuple(r) for r in rows.join(ids, "rcid", "left_semi").select(*rows.columns).collect()]

    extracts = MemoryTables(
        spark,
        {"company_ref": rows_of(extraction.companies(tables(spark), BIOPHARM))}
        | {table: extract(table) for table in extraction.FACTS},
        extracted=True,
    )
    assert rows_of(plan(extracts, BIOPHARM)) == broadcast

    monkeypatch.setattr(firm_ops.FirmUniverse, "small", property(lambda self: False))
    assert rows_of(plan(tables(spark), BIOPHARM)) == broadcast


def test_size_check_decides_on_the_broadcast(spark):
    firms_seen = extraction.universe(tables(spark), BIOPHARM)
    few = firm_ops.FirmUniverse(firms_seen.firms, firms_seen.ids, broadcast_rows=5)
    many = firm_ops.FirmUniverse(firms_seen.firms, firms_seen.ids, broadcast_rows=4)
    assert few.small and not many.small  # five id rows, one of them a repeat

    def hinted(universe):
        plan = universe.keep(tables(spark).frame("user_positions"))
        return "strategy=broadcast" in plan._jdf.queryExecution().logical().toString()

    assert hinted(few) and not hinted(many)


def test_many_firms_are_met_after_grouping(spark, monkeypatch):
    """Pairs are made distinct below the shuffle join, never on its partitioning by firm."""
    monkeypatch.setattr(firm_ops.FirmUniverse, "small", property(lambda self: False))
    pairs = firms.active_user_firms(tables(spark), BIOPHARM)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("Aggregate")
    counts = firms.firm_employee_counts(tables(spark), BIOPHARM)
    assert "LeftSemi" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_hot_firm_is_split_in_the_shuffle_join(spark):
    """A third and more of the rows at one firm must not end up in one task."""
    session = spark.newSession()
    for key, value in {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }.items():
        session.conf.set(key, value)
    facts = session.range(0, 60_000, 1, 8).selectExpr(
        "CASE WHEN id % 2 = 0 THEN 7 ELSE id % 500 END AS rcid", "id AS job_id", "md5(string(id)) AS x"
    )
    ids = session.range(500).withColumnRenamed("id", "rcid")
    kept = firm_ops.FirmUniverse(ids, ids, broadcast_rows=0).keep(facts)
    assert len(kept.collect()) == 60_000
    assert "skew=true" in kept._jdf.queryExecution().executedPlan().toString()


def test_bitmaps_count_as_distinct_counts_do(spark):
    ids = [0, 1, -1, 32767, 32768, 32769, -32768, -32769, 2**40, 2**62, -(2**62), None, 5, 5]
    rows = [(k, i) for k in range(3) for i in ids[k:]] + [(None, 7), (None, None), (9, None)]
    frame = spark.createDataFrame(rows, "k long, id long").repartition(4)
    state = bitmaps.bitmap_state(frame, ("k",), "id")
    wanted = frame.groupBy("k").agg(F.count_distinct("id").alias("n")).where("n > 0")
    assert rows_of(bitmaps.id_counts(state, "n", "k")) == rows_of(wanted)
    assert rows_of(bitmaps.id_counts(state, "n")) == rows_of(frame.agg(F.count_distinct("id")))
    assert rows_of(bitmaps.id_counts(bitmaps.bitmap_state(frame.limit(0), ("k",), "id"), "n")) == [(0,)]


def test_bitmaps_of_far_ids_stay_small_and_hash(spark):
    """Each firm holds twenty ids far apart: a state of words, not of bitmaps of 4 KB that aggregates have to sort."""
    frame = spark.range(20_000).selectExpr("id % 1000 AS k", "id * 1000003 - 9000000 AS id")
    state = bitmaps.bitmap_state(frame, ("k",), "id")
    assert state.schema[bitmaps.BITS].dataType.simpleString() == "bigint"
    for made in (state, bitmaps.merged(state), bitmaps.id_counts(state, "n", "k")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert rows_of(bitmaps.id_counts(state, "n")) == [(20_000,)]
    assert set(r.n for r in bitmaps.id_counts(state, "n", "k").collect()) == {20}


def test_employees_by_level_count_people_once(spark, tmp_path):
    """User 10 works for two firms of one country: twice by firm, once by country."""
    given = tables(spark)
    given.rows["user_positions"] = POSITIONS + [(11, 10, 4, "2020-01-01", None, "Admin", "clerk")]
    made = rows_of(firms.employees_by_level(firms.employee_state(given, BIOPHARM)))
    assert made == [("all", None, None, 3), ("country", "Peru", None, 3), ("firm", "Peru", 1, 2), ("firm", "Peru", 4, 2)]


def test_a_join_fails_on_a_firm_that_stands_twice(spark):
    left = spark.createDataFrame([(1, "Peru", 2), (2, "Peru", 3)], "rcid long, hq_country string, employee_count long")
    right = spark.createDataFrame([(1, "Peru", 5), (2, "Peru", 0)], "rcid long, hq_country string, posting_count long")
    assert rows_of(firm_ops.join_firm_counts(left, right, validate=True)) == rows_of(firm_ops.join_firm_counts(left, right))
    for sides, subject in (((left.union(left.limit(1)), right), "left"), ((left, right.union(right.limit(1))), "right")):
        assert firm_ops.join_firm_counts(*sides).count() == 3
        with pytest.raises(Exception, match=f"one_to_one of {subject}: rcid 1 is repeated"):
            firm_ops.join_firm_counts(*sides, validate=True).collect()
    universe = FirmUniverse(left.select("rcid", "hq_country"), left.select("rcid"))
    with pytest.raises(Exception, match="one_to_one of n"):
        universe.with_counts(spark.createDataFrame([(1, 1), (1, 2)], "rcid long, n long"), "n", validate=True).collect()


def shuffled_records(frame):
    """Records that each exchange of the executed plan wrote, after a collect."""
    found = []

    def walk(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if name.endswith("QueryStage"):
            return walk(plan.plan())
        if name == "Exchange":
            found.append(plan.metrics().apply("shuffleRecordsWritten").value())
        children = plan.children()
        for i in range(children.size()):
            walk(children.apply(i))

    frame.collect()
    walk(frame._jdf.queryExecution().executedPlan())
    return found


def test_many_ids_filter_facts_before_the_shuffle(spark, tmp_path):
    """Above the bound of a broadcast, a Bloom filter of the ids drops other facts ahead of the exchange."""
    spark.range(20_000).selectExpr("id AS rcid", f"IF(id % 100 = 0, '{PHARMA}', 'Retail') AS rics_k400").write.parquet(f"{tmp_path}/c")
    spark.range(100_000).selectExpr("id % 20000 AS rcid", "id AS x").write.parquet(f"{tmp_path}/f")
    prefix = "spark.sql.optimizer.runtime.bloomFilter"
    settings = {
        f"{prefix}.applicationSideScanSizeThreshold": "0", f"{prefix}.creationSideThreshold": "256MB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    old = {name: spark.conf.get(name) for name in (*settings, f"{prefix}.enabled")}
    records, rows = {}, {}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        for on in ("true", "false"):
            spark.conf.set(f"{prefix}.enabled", on)
            ids = firm_ops.in_industries(spark.read.parquet(f"{tmp_path}/c"), (PHARMA,)).select("rcid")
            kept = FirmUniverse(ids, ids, broadcast_rows=0).keep(spark.read.parquet(f"{tmp_path}/f"))
            assert ("might_contain" in kept._jdf.queryExecution().optimizedPlan().toString()) == (on == "true")
            rows[on] = rows_of(kept)
            records[on] = max(shuffled_records(kept))
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    assert rows["true"] == rows["false"] and len(rows["true"]) == 1000
    assert records["false"] == 100_000 and records["true"] < 10_000
