import datetime
import random

import pandas as pd
import pytest
from frames import rows_of

from spelltally.operators import roles, spells

CATEGORIES = ("Scientist", "Engineer")
SPELLS = "user_id long, rcid long, startdate date, job_category string, role string"


def random_spells(number, seed):
    draw = random.Random(seed)
    return [
        (
            draw.choice([None, 1, 2, 3, 4, 5]),
            draw.choice([None, 7, 8, 9]) if draw.random() < 0.7 else 7,
            datetime.date(2020, 1, 1) + datetime.timedelta(days=draw.randint(0, 3)),
            draw.choice(["Scientist", "Engineer"]),
            draw.choice(["a", "b", "c", "Missing"]),
        )
        for _ in range(number)
    ]


def brute_primary(rows):
    best = {}
    for user, firm, start, category, role in rows:
        choice = (-start.toordinal(), category, role)
        if (user, firm) not in best or choice < best[user, firm][0]:
            best[user, firm] = (choice, (user, firm, start, category, role))
    return sorted((row for _, row in best.values()), key=repr)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("parts", [1, 5])
def test_primary_spells_against_brute_force(spark, seed, parts):
    rows = random_spells(200, seed)
    frame = spark.createDataFrame(rows, SPELLS).repartition(parts)
    assert rows_of(spells.primary_spells(frame, "role")) == brute_primary(rows)


def test_primary_spell_puts_null_last(spark):
    day = datetime.date(2020, 1, 1)
    rows = [(1, 1, None, "A", "a"), (1, 1, day, None, "a"), (1, 1, day, "B", None), (1, 1, day, "B", "z")]
    frame = spark.createDataFrame(rows, SPELLS)
    assert rows_of(spells.primary_spells(frame, "role")) == [(1, 1, day, "B", "z")]


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_and_diagnostics_against_brute_force(spark, seed):
    rows = random_spells(60, seed)
    frame = spark.createDataFrame(rows, SPELLS)
    known = {}
    for user, firm, _, category, role in rows:
        if user is not None and firm is not None:
            seen = known.setdefault((user, firm), (set(), set()))
            seen[0].add(role)
            seen[1].add(category)
    expected = sorted(((*k, len(r), len(c)) for k, (r, c) in known.items()), key=repr)
    assert rows_of(spells.overlap_counts(frame, "role", CATEGORIES)) == expected

    primary = brute_primary(rows)
    pairs = len(primary)
    values = {
        "active_focal_position_rows": (len(rows), None),
        "active_focal_employee_firm_pairs": (pairs, 1.0),
    }
    for metric, value in (
        ("employee_firm_pairs_with_multiple_roles", sum(len(r) > 1 for r, _ in known.values())),
        ("employee_firm_pairs_with_multiple_categories", sum(len(c) > 1 for _, c in known.values())),
        ("employee_firm_pairs_with_missing_primary_role", sum(p[4] == "Missing" for p in primary)),
    ):
        values[metric] = (value, value / pairs)
    got = roles.role_selection_diagnostics(spells.pair_summary(frame, "role")).collect()
    assert {r["metric"]: (r["value"], r["share_of_employee_firm_pairs"]) for r in got} == values


def test_overlap_counts_null_as_a_value(spark):
    day = datetime.date(2020, 1, 1)
    rows = [(1, 1, day, "A", None), (1, 1, day, "A", "x"), (1, 1, day, "A", "x")]
    frame = spark.createDataFrame(rows, SPELLS)
    assert rows_of(spells.overlap_counts(frame, "role", ("A", "B"))) == [(1, 1, 2, 1)]


def brute_composition(rows, sample):
    counts = pd.Series([row[4] for row in rows]).value_counts()
    ordered = sorted(counts.items(), key=lambda item: (-item[1], item[0]))
    total, running, result = sum(counts), 0, []
    for rank, (role, number) in enumerate(ordered, start=1):
        running += number
        result.append((sample, role, number, total, number / total, rank, running / total))
    return result


@pytest.mark.parametrize("seed", range(3))
def test_composition_and_concentration(spark, seed):
    rows = brute_primary(random_spells(150, seed))
    frame = spark.createDataFrame(rows, SPELLS)
    expected = brute_composition(rows, "All")
    for category in ("Engineer", "Scientist"):
        members = [row for row in rows if row[3] == category]
        if members:
            expected += brute_composition(members, category)
    composition = roles.role_composition(frame, "role", "All")
    assert rows_of(composition) == sorted(expected, key=repr)

    for row in roles.role_concentration(composition).collect():
        part = [e for e in expected if e[0] == row["sample"]]
        shares = [e[4] for e in part]
        assert row["employee_firm_count"] == part[0][3]
        assert row["distinct_role_count"] == len(part)
        assert row["top_5_share"] == pytest.approx(sum(shares[:5]))
        assert row["herfindahl_index"] == pytest.approx(sum(s * s for s in shares))
        assert row["effective_role_count"] == pytest.approx(1 / sum(s * s for s in shares))
        assert part[-1][6] == 1.0


def test_tied_roles_are_ranked_by_name_and_one_role_gives_index_one(spark):
    day = datetime.date(2020, 1, 1)
    rows = [(i, 1, day, "Engineer", role) for i, role in enumerate(["b", "a", "c", "a", "b", "c"])]
    composition = roles.role_composition(spark.createDataFrame(rows, SPELLS), "role", "All")
    ranks = composition.where("sample = 'All'").orderBy("rank").collect()
    assert [r["role"] for r in ranks] == ["a", "b", "c"]
    assert [r["role"] for r in roles.top_roles_overall(composition, "All", 2).collect()] == ["b", "a"]
    top = roles.top_roles_by_category(composition, ("Scientist", "Engineer"), 1).collect()
    assert [(r["sample"], r["role"]) for r in top] == [("Engineer", "a")]

    single = roles.role_composition(
        spark.createDataFrame([(1, 1, day, "Engineer", "a")], SPELLS), "role", "All"
    )
    assert {r["herfindahl_index"] for r in roles.role_concentration(single).collect()} == {1.0}


def test_empty_sample_has_no_rows(spark):
    empty = roles.role_composition(spark.createDataFrame([], SPELLS), "role", "All")
    assert empty.count() == 0
    assert roles.role_concentration(empty).count() == 0


def test_picks_by_number_are_those_by_text(spark):
    """Nulls in every part, ties, far dates, names in byte order, a hot pair."""
    rng = random.Random(4)
    names, categories = ["b", "a", "é", "Z", "zz", ""], ("Scientist", "Engineer")
    days = [None, "1677-09-22", "2262-04-11", "2020-01-01", "2020-01-02", "1969-12-31"]
    rows = [
        (rng.choice([None, 1, 2, 3]), rng.choice([None, 7, 8]), rng.choice(days), rng.choice([None, *categories]), rng.choice([None, *names]))
        for _ in range(600)
    ]
    given = spark.createDataFrame(rows, "user_id long, rcid long, d string, job_category string, r string").selectExpr(
        "user_id", "rcid", "CAST(d AS DATE) AS startdate", "job_category", "r"
    )
    codes = spells.role_dictionary(given, "r")
    made = spells.primary_spells_by_number(given, "r", categories, codes)
    assert rows_of(made) == rows_of(spells.primary_spells(given, "r"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    summary = spells.pair_summary_by_number(given, "r", categories, codes)
    assert rows_of(summary) == rows_of(spells.pair_summary(given, "r"))
    assert spells.role_dictionary(given, "r", most=3) is None
