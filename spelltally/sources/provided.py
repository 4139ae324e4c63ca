"""The source tables as views over the provided test tables (FIXTURES.md, section 3).

Each column is one SQL expression that Spark and DuckDB both run, so the view has a
single definition. The provided tables hold no nulls and no bad dates; the expressions
add them by arithmetic on keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER_DAY = "CAST(o_orderdate AS DATE)"
SHIP_DAY = "CAST(l_shipdate AS DATE)"


def _flawed(day: str, key: str) -> str:
    """Date text, with a share of nulls, blanks, bad text, far dates and padding."""
    day = f"CAST({day} AS STRING)"
    return (
        f"CASE WHEN {key} % 37 = 0 THEN NULL WHEN {key} % 41 = 0 THEN '  ' "
        f"WHEN {key} % 43 = 0 THEN 'unknown' WHEN {key} % 47 = 0 THEN '9999-12-31' "
        f"WHEN {key} % 53 = 0 THEN ' ' || {day} ELSE {day} END"
    )


LINE_CATEGORY = (
    "CASE l_returnflag WHEN 'A' THEN 'Scientist' WHEN 'R' THEN 'Engineer' ELSE 'Admin' END"
)
ORDER_CATEGORY = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'Scientist' WHEN '2-HIGH' THEN 'Engineer' "
    "ELSE 'Admin' END"
)


@dataclass(frozen=True)
class View:
    """A base table, the lookups a column may need, and the columns.

    A lookup is a left join on the unique key of another table, so leaving out one
    that no wanted column needs does not change the rows.
    """

    base: str
    lookups: dict[str, tuple[str, str]] = field(default_factory=dict)
    columns: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)

    def frame(self, table: Callable[[str], DataFrame], *wanted: str) -> DataFrame:
        wanted = wanted or tuple(self.columns)
        needed = {name for column in wanted for name in self.columns[column][1]}
        frame = table(self.base)
        for name, (left, right) in self.lookups.items():
            if name in needed:
                side = table(name)
                frame = frame.join(side, F.col(left) == F.col(right), "left")
        return frame.select(*(F.expr(self.columns[c][0]).alias(c) for c in wanted))

    def sql(self) -> str:
        select = ", ".join(f"{expr} AS {name}" for name, (expr, _) in self.columns.items())
        joins = " ".join(
            f"LEFT JOIN {name} ON {left} = {right}"
            for name, (left, right) in self.lookups.items()
        )
        return f"SELECT {select} FROM {self.base} {joins}"


CUSTOMER_NATION = ("nation",)
CUSTOMER_REGION = ("nation", "region")
SUPPLIER_NATION = ("supplier", "nation")
SUPPLIER_REGION = ("supplier", "nation", "region")

VIEWS = {
    "company_ref": View(
        base="customer",
        lookups={
            "nation": ("c_nationkey", "n_nationkey"),
            "region": ("n_regionkey", "r_regionkey"),
        },
        columns={
            "rcid": ("c_custkey", ()),
            "company": ("c_name", ()),
            "hq_country": (
                "CASE WHEN c_custkey % 23 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN '   ' "
                "WHEN c_custkey % 31 = 0 THEN ' ' || n_name || ' ' ELSE n_name END",
                CUSTOMER_NATION,
            ),
            "rics_k50": ("r_name", CUSTOMER_REGION),
            "rics_k400": ("c_mktsegment", ()),
        },
    ),
    "user_positions": View(
        base="lineitem",
        lookups={
            "orders": ("l_orderkey", "o_orderkey"),
            "part": ("l_partkey", "p_partkey"),
            "supplier": ("l_suppkey", "s_suppkey"),
            "nation": ("s_nationkey", "n_nationkey"),
            "region": ("n_regionkey", "r_regionkey"),
        },
        columns={
            "position_id": ("l_orderkey * 10 + l_linenumber", ()),
            "user_id": ("CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_suppkey END", ()),
            "rcid": ("o_custkey", ("orders",)),
            "startdate": (_flawed(f"LEAST({ORDER_DAY}, {SHIP_DAY})", "l_partkey"), ("orders",)),
            "enddate": (
                "CASE WHEN l_linenumber = 1 THEN NULL ELSE "
                + _flawed(f"GREATEST({ORDER_DAY}, {SHIP_DAY})", "l_orderkey")
                + " END",
                ("orders",),
            ),
            "job_category": (LINE_CATEGORY, ()),
            "role_k1500": (
                "CASE WHEN l_partkey % 59 = 0 THEN NULL WHEN l_partkey % 61 = 0 THEN ' ' "
                "ELSE p_type || ' ' || p_brand END",
                ("part",),
            ),
            "region": ("r_name", SUPPLIER_REGION),
            "country": ("n_name", SUPPLIER_NATION),
        },
    ),
    "postings_linkedin": View(
        base="orders",
        columns={
            "job_id": ("CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_orderkey END", ()),
            "rcid": ("o_custkey", ()),
            "post_date": (_flawed(ORDER_DAY, "o_orderkey"), ()),
            "job_category": (ORDER_CATEGORY, ()),
        },
    ),
    "postings_indeed": View(
        base="lineitem",
        columns={
            "job_id": ("l_orderkey", ()),
            "rcid": ("l_partkey", ()),
            "post_date": (_flawed(SHIP_DAY, "l_partkey"), ()),
            "job_category": (LINE_CATEGORY, ()),
        },
    ),
    "user_education": View(
        base="lineitem",
        lookups={
            "supplier": ("l_suppkey", "s_suppkey"),
            "nation": ("s_nationkey", "n_nationkey"),
        },
        columns={
            "user_id": ("CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_suppkey END", ()),
            "education_number": ("CAST(l_linenumber AS INT)", ()),
            "startdate": (_flawed(SHIP_DAY, "l_partkey"), ()),
            "degree": ("CASE WHEN l_partkey % 59 = 0 THEN NULL ELSE l_returnflag END", ()),
            "university_country": ("n_name", SUPPLIER_NATION),
        },
    ),
    "user_age": View(
        base="supplier",
        columns={
            "user_id": ("s_suppkey", ()),
            "earliest_grad_year": (
                "CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE CAST(1970 + s_suppkey % 50 AS INT) END",
                (),
            ),
            "estimated_birth_year": ("CAST(1948 + s_suppkey % 50 AS INT)", ()),
            "age": ("CAST(74 - s_suppkey % 50 AS INT)", ()),
        },
    ),
    "user_demography": View(
        base="supplier",
        lookups={"nation": ("s_nationkey", "n_nationkey")},
        columns={
            "user_id": ("s_suppkey", ()),
            "fullname": ("s_name", ()),
            "f_prob": ("CAST(s_suppkey % 5 AS DOUBLE) / 4", ()),
            "prestige": ("CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_acctbal END", ()),
            "user_country": ("n_name", ("nation",)),
        },
    ),
}


@dataclass(frozen=True)
class ProvidedTables:
    """Reads the mapped views of one test-data folder."""

    spark: SparkSession
    folder: str
    opened: dict[str, DataFrame] = field(default_factory=dict, compare=False)

    def raw(self, name: str) -> DataFrame:
        """A provided table; listing its files and reading its footer happen once."""
        if name not in self.opened:
            self.opened[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.opened[name]

    def frame(self, name: str, *columns: str) -> DataFrame:
        """A mapped source table; only the lookups its columns need are joined."""
        return VIEWS[name].frame(self.raw, *columns)
