"""Small tables held in memory, in the shape the plans ask for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "company_ref": "rcid long, company string, hq_country string, rics_k50 string, rics_k400 string",
    "user_positions": (
        "position_id long, user_id long, rcid long, startdate string, enddate string, "
        "job_category string, role_k1500 string"
    ),
    "postings_linkedin": "job_id long, rcid long, post_date string, job_category string",
    "postings_indeed": "job_id long, rcid long, post_date string, job_category string",
}


@dataclass
class MemoryTables:
    spark: SparkSession
    rows: dict[str, list[tuple]] = field(default_factory=dict)
    extracted: bool = False

    def frame(self, name: str, *columns: str) -> DataFrame:
        table = self.spark.createDataFrame(self.rows.get(name, []), SCHEMAS[name])
        return table.select(*columns) if columns else table


def rows_of(frame: DataFrame) -> list[tuple]:
    return sorted((tuple(row) for row in frame.collect()), key=repr)
