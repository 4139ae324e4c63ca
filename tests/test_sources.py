import os

import pytest
from frames import MemoryTables, rows_of
from test_firms import COMPANIES, INDEED, LINKEDIN, POSITIONS

from spelltally.config import BIOPHARM, STUDIES
from spelltally.plans import checks, extraction, firms, inspection
from spelltally.plans.report import run_report
from spelltally.schemas import SOURCE_TABLES
from spelltally.sources import scans, scratch, sinks
from spelltally.sources.tables import CatalogTables, ParquetTables


@pytest.fixture
def tables(spark):
    return MemoryTables(
        spark,
        {
            "company_ref": COMPANIES,
            "user_positions": POSITIONS,
            "postings_linkedin": LINKEDIN,
            "postings_indeed": INDEED,
        },
    )


def files(path, ending):
    return [name for name in os.listdir(path) if name.endswith(ending)]


def test_csv_keeps_na_as_text(spark, tmp_path):
    frame = spark.createDataFrame([(1, "NA"), (2, "null"), (3, None)], "rcid long, hq_country string")
    sinks.write_csv(frame, str(tmp_path / "csv"))
    back = scans.scan_csv(spark, str(tmp_path / "csv"), frame.schema)
    assert rows_of(back) == [(1, "NA"), (2, "null"), (3, None)]
    only = scans.scan_csv(spark, str(tmp_path / "csv"), frame.schema, "hq_country")
    assert only.columns == ["hq_country"]


def test_scan_parquet_reads_the_named_columns_only(spark, tmp_path):
    spark.range(5).selectExpr("id AS a", "id AS b").write.parquet(str(tmp_path / "t"))
    frame = scans.scan_parquet(spark, str(tmp_path / "t"), "b")
    assert "ReadSchema: struct<b:bigint>" in frame._jdf.queryExecution().toString()


def test_table_overwrite_replaces_rows_and_schema(spark):
    name = scratch.scratch_table(spark, "t")
    assert sinks.write_table(spark.range(3), name).count() == 3
    again = sinks.write_table(spark.createDataFrame([("x",)], "s string"), name)
    assert again.columns == ["s"] and rows_of(again) == [("x",)]
    spark.sql(f"DROP TABLE {name}")


def test_a_failing_write_leaves_the_old_rows(spark, tmp_path):
    broken = spark.range(0, 100, 1, 4).selectExpr("IF(id > 60, raise_error('broken'), id) AS id")
    name, path = scratch.scratch_table(spark, "t"), str(tmp_path / "t")
    sinks.write_table(spark.range(3), name)
    sinks.write_parquet(spark.range(3), path)
    sinks.write_csv(spark.range(3), path + "_csv")
    for write, place in ((sinks.write_table, name), (sinks.write_parquet, path), (sinks.write_csv, path + "_csv")):
        with pytest.raises(Exception, match="broken"):
            write(broken, place)
    assert spark.read.table(name).count() == spark.read.parquet(path).count() == 3
    assert scans.scan_csv(spark, path + "_csv", "id long").count() == 3
    assert sorted(os.listdir(tmp_path)) == ["t", "t_csv"]
    # A frame may replace what it reads.
    assert sinks.write_parquet(spark.read.parquet(path).selectExpr("id + 1 AS id"), path).agg({"id": "sum"}).first()[0] == 6
    assert sinks.write_table(spark.read.table(name).selectExpr("id + 1 AS id"), name).agg({"id": "sum"}).first()[0] == 6
    spark.sql(f"DROP TABLE {name}")


def test_csv_files_are_bounded(spark, tmp_path):
    frame = spark.range(0, 250, 1, 1)
    sinks.write_csv(frame, str(tmp_path / "csv"), rows_per_file=100)
    assert len(files(tmp_path / "csv", ".csv")) == 3
    assert rows_of(scans.scan_csv(spark, str(tmp_path / "csv"), "id long")) == rows_of(frame)


def test_single_part_is_one_file(spark, tmp_path):
    frame = spark.range(0, 100, 1, 4)
    sinks.write_parquet(frame, str(tmp_path / "many"))
    assert len(files(tmp_path / "many", ".parquet")) == 4
    back = sinks.write_parquet(frame, str(tmp_path / "one"), single_part=True)
    assert len(files(tmp_path / "one", ".parquet")) == 1 and back.count() == 100


def test_csv_keeps_texts(spark, tmp_path):
    texts = [" padded ", "", None, 'a "quote"', "a,comma", "back\\slash", "line\nbreak", "\ttab", "end\\"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sinks.write_csv(frame, str(tmp_path / "texts"))
    back = scans.scan_csv(spark, str(tmp_path / "texts"), frame.schema)
    assert [r.text for r in back.orderBy("id").collect()] == [t or None for t in texts]


def test_kept_releases_the_frame(spark):
    with sinks.kept(spark.range(5)) as frame:
        assert frame.count() == 5 and frame.storageLevel.useMemory
    assert not frame.storageLevel.useMemory


class FakeSession:
    """Stands for a session on a cluster, with or without a named folder."""

    def __init__(self, named=None):
        self.named, self.conf, self.sparkContext, self.master = named, self, self, "yarn"

    def get(self, key, default):
        return self.named if key == "spark.checkpoint.dir" and self.named else default


def test_scratch_uses_the_named_folder():
    path = scratch.scratch_path(FakeSession("hdfs://shared/folder/"), "x")
    assert path.startswith("hdfs://shared/folder/spelltally/x-")


def test_scratch_refuses_a_cluster_without_a_named_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_root(FakeSession())


def test_schemas_name_each_column_once():
    sizes = {name: len(table.columns) for name, table in SOURCE_TABLES.items()}
    assert sizes == {
        "company_ref": 32, "postings_linkedin": 34, "postings_indeed": 34,
        "user_positions": 49, "user_education": 16, "user_age": 4, "user_demography": 22,
    }
    for table in SOURCE_TABLES.values():
        assert len(set(table.columns)) == len(table.columns)
        assert set(table.key) <= set(table.columns)
    assert set(STUDIES) == {"biopharm", "automation", "electronics"}


def test_project_fails_on_a_missing_column(spark):
    table = SOURCE_TABLES["user_age"]
    frame = spark.sql("SELECT 1 AS age, 2 AS estimated_birth_year, 3 AS earliest_grad_year, 4 AS user_id")
    assert table.project(frame).columns == list(table.columns)
    with pytest.raises(Exception, match="age"):
        table.project(frame.drop("age")).columns


def test_catalog_tables(spark):
    spark.range(3).selectExpr("id AS rcid", "id AS x").createOrReplaceTempView("pre_company_ref")
    assert CatalogTables(spark, "pre_").frame("company_ref", "rcid").columns == ["rcid"]


def test_extraction_then_report(spark, tables, tmp_path):
    database = scratch.scratch_table(spark, "x").split(".")[0]
    spark.sql(f"USE {database}")
    try:
        written = extraction.run_extraction(tables, BIOPHARM, str(tmp_path / "extracts"))
        assert {name: frame.count() for name, frame in written.items()} == {
            "company_ref": 4, "user_positions": 8, "postings_linkedin": 5, "postings_indeed": 3,
        }
        assert spark.read.table("biopharm_user_positions").count() == 8
    finally:
        spark.sql("USE default")

    extracts = ParquetTables(spark, str(tmp_path / "extracts"), extracted=True)
    names = run_report(extracts, BIOPHARM, str(tmp_path / "report"))
    assert len(names) == len(set(names)) == 24
    active = scans.scan_csv(
        spark,
        str(tmp_path / "report" / "active_firms"),
        "rcid long, hq_country string, employee_count long, posting_count long, active_firm boolean",
    )
    assert rows_of(active) == rows_of(firms.active_firms(tables, BIOPHARM))


def test_report_reads_each_fact_table_once(spark, tables, tmp_path):
    read = []

    class Counted:
        def frame(self, name, *columns):
            read.append(name)
            return tables.frame(name, *columns)

    run_report(Counted(), BIOPHARM, str(tmp_path))
    assert [name for name in sorted(read) if name != "company_ref"] == ["postings_indeed", "postings_linkedin", "user_positions"]
    dates = scans.scan_csv(
        spark, str(tmp_path / "date_diagnostics_positions"),
        "dataset string, variable string, row_count long, missing_or_blank_count long, "
        "nonmissing_string_count long, failed_conversion_count long, failed_conversion_share double",
    )
    assert rows_of(dates) == rows_of(checks.position_dates(tables, BIOPHARM))


def test_report_stops_on_a_null_company_key(spark, tables, tmp_path):
    tables.rows["company_ref"] = COMPANIES + [(None, "Nameless", "Peru", "k", "Pharmaceuticals")]
    with pytest.raises(ValueError, match="key_not_null"):
        run_report(tables, BIOPHARM, str(tmp_path))


class NumberedTables:
    """Every source table with its validated columns, all numbers, and one column too many."""

    def __init__(self, spark):
        self.spark = spark

    def frame(self, name, *columns):
        names = SOURCE_TABLES[name].columns
        values = ", ".join(f"CAST(id % {i % 3 + 1} AS STRING) AS {c}" for i, c in enumerate(names))
        table = self.spark.range(0, 1500, 1, 3).selectExpr(*values.split(", "), "id AS extra")
        return table.select(*columns) if columns else table


@pytest.mark.parametrize("name", SOURCE_TABLES)
def test_inspection(spark, tmp_path, name):
    database = scratch.scratch_table(spark, "x").split(".")[0]
    spark.sql(f"USE {database}")
    try:
        written = inspection.run_inspection(NumberedTables(spark), name, str(tmp_path))
    finally:
        spark.sql("USE default")
    sample = written.pop("sample")
    assert sample.count() == 1000 and sample.columns == list(SOURCE_TABLES[name].columns)
    profile = {(r["subject"], r["metric"]): r["value"] for r in written.pop("profile").collect()}
    assert profile["*", "row_count"] == 1500
    assert sum(metric == "null_count" for _, metric in profile) == len(SOURCE_TABLES[name].columns)
    assert set(written) == {
        "company_ref": {"universe_industries"},
        "postings_linkedin": {"universe_roles"},
        "postings_indeed": {"universe_roles"},
        "user_positions": {"universe_roles", "universe_geography"},
    }.get(name, set())
    for frame in written.values():
        assert frame.count() == frame.distinct().count() <= 6
