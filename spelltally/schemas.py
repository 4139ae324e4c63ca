"""Source tables: validated columns, declared keys and category levels.

All values in this file are fixed: they are the column names of the delivered tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class SourceTable:
    name: str
    key: tuple[str, ...]
    columns: tuple[str, ...]

    def project(self, frame: DataFrame) -> DataFrame:
        """Keep the validated columns in their order; fails if one is absent."""
        return frame.select(*self.columns)


COMPANY_REF = SourceTable(
    name="company_ref",
    key=("rcid",),
    columns=(
        "rcid", "company", "primary_name", "factset_entity_id", "year_founded", "ticker",
        "exchange_name", "sedol", "isin", "cusip", "url", "naics_code", "cik", "lei",
        "linkedin_url", "child_rcid", "child_company", "child_linkedin_url", "ultimate_parent_rcid",
        "ultimate_parent_rcid_name", "gvkey", "ein", "hq_street_address", "hq_zip_code", "hq_city",
        "hq_metro_area", "hq_state", "hq_country", "hq_region", "rics_k50", "rics_k200",
        "rics_k400",
    ),
)

POSTING_COLUMNS = (
    "job_id", "rcid", "company", "rics_k50", "rics_k200", "rics_k400", "title_raw",
    "title_translated", "job_category", "role_k50", "role_k150", "role_k300", "role_k500",
    "role_k1000", "role_k1250", "role_k1500", "location_raw", "region", "country", "state",
    "metro_area", "salary", "post_date", "remove_date", "ultimate_parent_rcid",
    "ultimate_parent_company_name", "onet_code", "onet_title", "remote_type", "jobtitle",
    "description", "salary_min", "salary_max", "salary_predicted",
)
POSTINGS_LINKEDIN = SourceTable("postings_linkedin", ("job_id",), POSTING_COLUMNS)
POSTINGS_INDEED = SourceTable("postings_indeed", ("job_id",), POSTING_COLUMNS)

USER_POSITIONS = SourceTable(
    name="user_positions",
    key=("position_id",),
    columns=(
        "user_id", "position_id", "company_raw", "company_linkedin_url", "company_cleaned", "rcid",
        "company_name", "location_raw", "city", "msa", "metro_area", "state", "country", "region",
        "startdate", "enddate", "title_raw", "job_category", "role_k50", "role_k150", "role_k300",
        "role_k500", "role_k1000", "role_k1500", "remote_suitability", "weight", "description",
        "start_salary", "end_salary", "salary", "seniority", "position_number",
        "ultimate_parent_rcid", "ultimate_parent_company_name", "onet_code", "onet_title", "ticker",
        "exchange", "cusip", "naics_code", "naics_description", "rics_k50", "rics_k200",
        "rics_k400", "ultimate_parent_factset_id", "ultimate_parent_factset_name",
        "total_compensation", "additional_compensation", "title_translated",
    ),
)

USER_EDUCATION = SourceTable(
    name="user_education",
    key=("user_id", "education_number"),
    columns=(
        "user_id", "university_raw", "university_name", "rsid", "education_number", "startdate",
        "enddate", "degree", "field", "degree_raw", "field_raw", "university_country",
        "university_location", "ultimate_parent_school_name", "ultimate_parent_rsid", "description",
    ),
)

USER_AGE = SourceTable(
    name="user_age",
    key=("user_id",),
    columns=("user_id", "earliest_grad_year", "estimated_birth_year", "age"),
)

USER_DEMOGRAPHY = SourceTable(
    name="user_demography",
    key=("user_id",),
    columns=(
        "user_id", "firstname", "lastname", "fullname", "f_prob", "m_prob", "white_prob",
        "black_prob", "api_prob", "hispanic_prob", "native_prob", "multiple_prob", "prestige",
        "highest_degree", "sex_predicted", "ethnicity_predicted", "user_location", "user_country",
        "profile_title", "updated_dt", "numconnections", "profile_summary",
    ),
)

SOURCE_TABLES = {
    table.name: table
    for table in (
        COMPANY_REF,
        POSTINGS_LINKEDIN,
        POSTINGS_INDEED,
        USER_POSITIONS,
        USER_EDUCATION,
        USER_AGE,
        USER_DEMOGRAPHY,
    )
}

# Column sets whose observed combinations are listed.
INDUSTRY_LEVELS = ("rics_k50", "rics_k200", "rics_k400", "naics_code")
POSTING_ROLE_LEVELS = (
    "job_category", "role_k50", "role_k150", "role_k300", "role_k500", "role_k1000",
    "role_k1250", "role_k1500",
)
POSITION_ROLE_LEVELS = (
    "job_category", "role_k50", "role_k150", "role_k300", "role_k500", "role_k1000",
    "role_k1500",
)
GEOGRAPHY_LEVELS = ("country", "state", "city")

UNIVERSES = {
    "company_ref": {"industries": INDUSTRY_LEVELS},
    "postings_linkedin": {"roles": POSTING_ROLE_LEVELS},
    "postings_indeed": {"roles": POSTING_ROLE_LEVELS},
    "user_positions": {"roles": POSITION_ROLE_LEVELS, "geography": GEOGRAPHY_LEVELS},
}
# Tables whose sample is drawn at random; the others give their first rows.
RANDOMLY_SAMPLED = ("user_age", "user_demography")
