"""Employment spells: activity, user-firm pairs and the primary spell of a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spelltally.functions.dates import active_at, parse_date, parse_date_trimmed, running_at
from spelltally.functions.text import label_or_missing
from spelltally.operators.dedup import nulls_last

PAIR = ("user_id", "rcid")
# A pick as one number: days back from the last readable one, category code, role code. The
# highest code of each part stands for null.
DAY_BITS, CATEGORY_BITS, ROLE_BITS = 18, 12, 32
LAST_DAY = 106_751
ROLE_CODES = 1 << 20


def of_categories(frame: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    return frame.where(F.col("job_category").isin(*categories))


def active_spells(
    positions: DataFrame, snapshot: str, parse=parse_date, read: tuple[str, str] | None = None
) -> DataFrame:
    """Spells running at the snapshot. ``read`` names columns that hold the parsed start and end."""
    if read:
        start, end = map(F.col, read)
        return positions.where(running_at(start, end, F.col("enddate"), snapshot))
    return positions.where(
        active_at(F.col("startdate"), F.col("enddate"), snapshot, parse)
    )


def focal_active_spells(
    positions: DataFrame, snapshot: str, categories: tuple[str, ...], parse=parse_date
) -> DataFrame:
    return active_spells(of_categories(positions, categories), snapshot, parse)


def role_spells(
    positions: DataFrame, snapshot: str, categories: tuple[str, ...], role: str
) -> DataFrame:
    """Focal active spells with a parsed start and a cleaned role; dates are trimmed first."""
    return focal_active_spells(positions, snapshot, categories, parse_date_trimmed).select(
        *PAIR,
        parse_date_trimmed(F.col("startdate")).alias("startdate"),
        "job_category",
        label_or_missing(F.col(role)).alias(role),
    )


def users_per_firm(pairs: DataFrame, name: str) -> DataFrame:
    """Users per firm from distinct pairs; a null user is not counted."""
    return pairs.groupBy("rcid").agg(F.count("user_id").alias(name))


def users_and_focal_users_per_firm(spells: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Users per firm, of all spells and of focal ones; pairs are made distinct once for both."""
    focal = F.col("job_category").isin(*categories)
    pairs = spells.groupBy("rcid", "user_id").agg(F.max(focal).alias("_focal"))
    return pairs.groupBy("rcid").agg(
        F.count("user_id").alias("employee_count"),
        F.count(F.when(F.col("_focal"), F.col("user_id"))).alias("focal_employee_count"),
    )


def _first_choice(role: str):
    """Order in which the spells of a pair are preferred: latest start, category, role."""
    return F.struct(
        nulls_last(-F.unix_date("startdate")).alias("_newest"),
        nulls_last(F.col("job_category")).alias("_category"),
        nulls_last(F.col(role)).alias("_role"),
        F.col("startdate"),
        F.col("job_category"),
        F.col(role),
    )


def primary_spells(spells: DataFrame, role: str) -> DataFrame:
    """One spell per user-firm pair; a null user or firm forms a pair like any value."""
    return (
        spells.groupBy(*PAIR)
        .agg(F.min(_first_choice(role)).alias("_pick"))
        .select(*PAIR, "_pick.startdate", "_pick.job_category", f"_pick.{role}")
    )


def role_dictionary(spells: DataFrame, role: str, most: int = ROLE_CODES) -> DataFrame | None:
    """Roles and their places in text order, to be sent out; none beyond ``most`` roles.

    The taxonomy has about 1,500.
    """
    names = spells.where(F.col(role).isNotNull()).select(role).distinct().orderBy(role).limit(most + 1).collect()
    if len(names) > most:
        return None
    return spells.sparkSession.createDataFrame([(name[0], i) for i, name in enumerate(names)], f"{role} string, _role_code long")


def _coded(spells: DataFrame, role: str, categories: tuple[str, ...], dictionary: DataFrame) -> DataFrame:
    """Spells with ``_category_code``, ``_role_code`` and ``_packed``, whose order is that of :func:`_first_choice`."""
    names = F.array(*map(F.lit, sorted(categories, key=str.encode)))
    category = F.array_position(names, F.col("job_category")) - 1

    def or_last(code: Column, bits: int) -> Column:
        return F.coalesce(code.cast("long"), F.lit((1 << bits) - 1))

    back = or_last(F.lit(LAST_DAY) - F.unix_date("startdate"), DAY_BITS)
    packed = F.shiftleft(back, CATEGORY_BITS + ROLE_BITS)
    packed = packed + F.shiftleft(or_last(F.col("_category_code"), CATEGORY_BITS), ROLE_BITS) + or_last(F.col("_role_code"), ROLE_BITS)
    coded = spells.join(F.broadcast(dictionary), role, "left").withColumn("_category_code", category)
    return coded.withColumn("_packed", packed)


def _unpacked(picks: DataFrame, role: str, categories: tuple[str, ...], dictionary: DataFrame) -> DataFrame:
    """Picks with startdate, job_category and the role in place of ``_packed``."""
    names = F.array(*map(F.lit, sorted(categories, key=str.encode)))
    back = F.shiftright("_packed", CATEGORY_BITS + ROLE_BITS)
    place = F.shiftright("_packed", ROLE_BITS).bitwiseAND((1 << CATEGORY_BITS) - 1).cast("int")
    day = F.when(back < (1 << DAY_BITS) - 1, F.date_from_unix_date((F.lit(LAST_DAY) - back).cast("int")))
    return (
        picks.withColumn("_role_code", F.col("_packed").bitwiseAND((1 << ROLE_BITS) - 1))
        .join(F.broadcast(dictionary), "_role_code", "left")
        .withColumns({"startdate": day, "job_category": F.get(names, place)})
        .drop("_role_code", "_packed")
    )


def primary_spells_by_number(spells: DataFrame, role: str, categories: tuple[str, ...], dictionary: DataFrame) -> DataFrame:
    """:func:`primary_spells` of spells in the categories, picked as numbers: a hash aggregate, nothing is sorted."""
    picks = _coded(spells, role, categories, dictionary).groupBy(*PAIR).agg(F.min("_packed").alias("_packed"))
    return _unpacked(picks, role, categories, dictionary).select(*PAIR, "startdate", "job_category", role)


def pair_summary_by_number(spells: DataFrame, role: str, categories: tuple[str, ...], dictionary: DataFrame) -> DataFrame:
    """:func:`pair_summary` of spells in the categories, by numbers."""
    known = F.col("user_id").isNotNull() & F.col("rcid").isNotNull()
    several = {"several_roles": "_role_code", "several_categories": "_category_code"}
    picks = (
        _coded(spells, role, categories, dictionary)
        .groupBy(*PAIR)
        .agg(
            F.count(F.lit(1)).alias("spell_rows"),
            F.min("_packed").alias("_packed"),
            *((F.min(code) != F.max(code)).alias(name) for name, code in several.items()),
        )
    )
    return _unpacked(picks, role, categories, dictionary).select(
        *PAIR,
        "spell_rows",
        F.col("job_category").alias("primary_category"),
        F.col(role).alias("primary_role"),
        *((known & F.col(name)).alias(name) for name in several),
    )


def overlap_counts(spells: DataFrame, role: str, categories: tuple[str, ...]) -> DataFrame:
    """Distinct roles, and how many of the categories occur, per pair with known user and firm.

    A null role is a value. One flag per category goes along with the roles, since two
    distinct counts side by side would double the rows before the shuffle.
    """
    flags = [f"_in_{i}" for i, _ in enumerate(categories)]
    per_role = (
        spells.where(" AND ".join(f"{name} IS NOT NULL" for name in PAIR))
        .groupBy(*PAIR, role)
        .agg(*(F.max(F.col("job_category") == c).alias(f) for f, c in zip(flags, categories)))
    )
    per_pair = per_role.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("role_count"), *(F.max(f).alias(f) for f in flags)
    )
    seen = sum((F.col(f).cast("long") for f in flags), F.lit(0))
    return per_pair.select(*PAIR, "role_count", seen.cast("long").alias("category_count"))


def pair_summary(spells: DataFrame, role: str) -> DataFrame:
    """Per pair: spell rows, the primary role, and whether roles or categories differ.

    Telling 'more than one' from smallest and largest keeps this to one aggregate.
    """
    known = F.col("user_id").isNotNull() & F.col("rcid").isNotNull()
    return (
        spells.groupBy(*PAIR)
        .agg(
            F.count(F.lit(1)).alias("spell_rows"),
            F.min(_first_choice(role)).alias("_pick"),
            F.min(role).alias("_role_low"),
            F.max(role).alias("_role_high"),
            F.min("job_category").alias("_category_low"),
            F.max("job_category").alias("_category_high"),
        )
        .select(
            *PAIR,
            "spell_rows",
            F.col("_pick.job_category").alias("primary_category"),
            F.col(f"_pick.{role}").alias("primary_role"),
            (known & (F.col("_role_low") != F.col("_role_high"))).alias("several_roles"),
            (known & (F.col("_category_low") != F.col("_category_high"))).alias(
                "several_categories"
            ),
        )
    )
