"""DuckDB twins of the Spark queries, written on their own from the stated semantics.

Only the views over the provided tables are shared with the Spark side.
"""

from __future__ import annotations

from spelltally.config import PROVIDED as STUDY
from spelltally.sources.provided import VIEWS


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def parse(text: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({text}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') "
        f"AND TRY_CAST({text} AS DATE) BETWEEN DATE '1677-09-22' AND DATE '2262-04-11' "
        f"THEN TRY_CAST({text} AS DATE) END"
    )


def blank(text: str) -> str:
    return f"({text} IS NULL OR trim({text}) = '')"


def country(text: str) -> str:
    return f"CASE WHEN {blank(text)} THEN 'Missing' ELSE trim({text}) END"


def active(start: str, end: str, end_text: str) -> str:
    day = f"DATE '{STUDY.snapshot}'"
    return f"({start} <= {day} AND ({blank(end_text)} OR {end} >= {day}))"


INDUSTRIES = quoted(STUDY.industries)
CATEGORIES = quoted(STUDY.categories)
FIRST, LAST = STUDY.period
SPELL = "position_id, user_id, rcid, startdate, enddate, job_category"
COMPANY = "rcid, company, hq_country, rics_k50, rics_k400"
POSITION = "position_id, user_id, rcid, startdate, enddate, job_category, role_k1500, region, country"
POSTING = "job_id, rcid, post_date, job_category"
EDUCATION = "user_id, education_number, startdate, degree, university_country"
AGE = "user_id, earliest_grad_year, estimated_birth_year, age"
DEMOGRAPHY = "user_id, fullname, f_prob, prestige, user_country"

# Named building blocks; each query takes the ones it names, in this order.
BLOCKS = {name: view.sql() for name, view in VIEWS.items()}
BLOCKS["companies"] = f"""
    SELECT {COMPANY} FROM (
        SELECT *, row_number() OVER (PARTITION BY rcid ORDER BY hq_country NULLS FIRST,
            company NULLS FIRST, rics_k50 NULLS FIRST, rics_k400 NULLS FIRST) AS pick
        FROM company_ref WHERE rics_k400 IN ({INDUSTRIES}))
    WHERE pick = 1"""
BLOCKS["universe"] = f"SELECT rcid, {country('hq_country')} AS hq_country FROM companies"
BLOCKS["focal_positions"] = (
    f"SELECT {POSITION} FROM user_positions WHERE rcid IN (SELECT rcid FROM companies)"
)
BLOCKS["focal_linkedin"] = (
    f"SELECT {POSTING} FROM postings_linkedin WHERE rcid IN (SELECT rcid FROM companies)"
)
BLOCKS["focal_indeed"] = (
    f"SELECT {POSTING} FROM postings_indeed WHERE rcid IN (SELECT rcid FROM companies)"
)
BLOCKS["pairs"] = f"""
    SELECT DISTINCT rcid, user_id FROM focal_positions
    WHERE {active(parse('startdate'), parse('enddate'), 'enddate')}"""
BLOCKS["focal_pairs"] = f"""
    SELECT DISTINCT rcid, user_id FROM focal_positions
    WHERE job_category IN ({CATEGORIES})
      AND {active(parse('startdate'), parse('enddate'), 'enddate')}"""
BLOCKS["job_keys"] = f"""
    SELECT source, job_id, min(rcid) AS rcid FROM (
        SELECT 'LinkedIn' AS source, * FROM focal_linkedin
        UNION ALL SELECT 'Indeed', * FROM focal_indeed)
    WHERE {parse('post_date')} BETWEEN DATE '{FIRST}' AND DATE '{LAST}'
      AND job_id IS NOT NULL AND rcid IS NOT NULL
    GROUP BY source, job_id"""
BLOCKS["employees"] = """
    SELECT u.rcid, u.hq_country, coalesce(n, 0)::BIGINT AS employee_count
    FROM universe u LEFT JOIN (
        SELECT rcid, count(DISTINCT user_id) AS n FROM pairs GROUP BY rcid) USING (rcid)"""
BLOCKS["focal_employees"] = """
    SELECT u.rcid, u.hq_country, coalesce(n, 0)::BIGINT AS focal_employee_count
    FROM universe u LEFT JOIN (
        SELECT rcid, count(DISTINCT user_id) AS n FROM focal_pairs GROUP BY rcid) USING (rcid)"""
BLOCKS["postings"] = """
    SELECT u.rcid, u.hq_country, coalesce(n, 0)::BIGINT AS posting_count
    FROM universe u LEFT JOIN (
        SELECT rcid, count(*) AS n FROM job_keys GROUP BY rcid) USING (rcid)"""
BLOCKS["activity"] = """
    SELECT e.rcid, e.hq_country, employee_count, posting_count,
           employee_count > 0 AND posting_count > 0 AS active_firm
    FROM employees e JOIN postings p ON e.rcid = p.rcid"""
BLOCKS["role_spells"] = f"""
    SELECT * FROM (
        SELECT user_id, rcid, job_category, enddate AS end_text,
               {parse('trim(startdate)')} AS start_day, {parse('trim(enddate)')} AS end_day,
               {country('role_k1500')} AS role_k1500
        FROM focal_positions WHERE job_category IN ({CATEGORIES}))
    WHERE {active('start_day', 'end_day', 'end_text')}"""
BLOCKS["primaries"] = """
    SELECT user_id, rcid, start_day AS startdate, job_category, role_k1500 FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, rcid
            ORDER BY start_day DESC, job_category, role_k1500) AS pick
        FROM role_spells)
    WHERE pick = 1"""
BLOCKS["role_overlaps"] = """
    SELECT user_id, rcid, count(DISTINCT role_k1500) AS role_count,
           count(DISTINCT job_category) AS category_count
    FROM role_spells WHERE user_id IS NOT NULL AND rcid IS NOT NULL
    GROUP BY user_id, rcid"""
BLOCKS["samples"] = f"""
    SELECT '{STUDY.all_sample}' AS sample, role_k1500 FROM primaries
    UNION ALL SELECT job_category, role_k1500 FROM primaries"""
BLOCKS["composition"] = """
    SELECT sample, role_k1500, n AS employee_firm_count,
           (sum(n) OVER whole)::BIGINT AS denominator_employee_firms,
           n / sum(n) OVER whole AS employee_firm_share,
           row_number() OVER ranked AS rank,
           (sum(n) OVER ranked) / (sum(n) OVER whole) AS cumulative_share
    FROM (SELECT sample, role_k1500, count(*) AS n FROM samples GROUP BY sample, role_k1500)
    WINDOW whole AS (PARTITION BY sample),
           ranked AS (PARTITION BY sample ORDER BY n DESC, role_k1500
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def with_blocks(select: str) -> str:
    """Prefix a SELECT with all blocks it may use; unused ones cost nothing."""
    return "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in BLOCKS.items()) + "\n" + select


def by_country(source: str, where: str = "TRUE") -> str:
    return (
        f"SELECT hq_country, count(DISTINCT rcid) AS company_count FROM {source} "
        f"WHERE {where} GROUP BY hq_country"
    )


def dates(source: str, dataset: str, variables, strip: bool = False) -> str:
    def one(name: str) -> str:
        value = f"trim({name})" if strip else name
        failed = f"count(*) FILTER (WHERE NOT {blank(name)} AND ({parse(value)}) IS NULL)"
        present = f"count(*) FILTER (WHERE NOT {blank(name)})"
        return f"""
            SELECT '{dataset}' AS dataset, '{name}' AS variable, count(*) AS row_count,
                   count(*) FILTER (WHERE {blank(name)}) AS missing_or_blank_count,
                   {present} AS nonmissing_string_count, {failed} AS failed_conversion_count,
                   round(CASE WHEN {present} = 0 THEN 0.0::DOUBLE
                              ELSE {failed}::DOUBLE / {present} END, 6)
                       AS failed_conversion_share
            FROM {source}"""

    return " UNION ALL ".join(one(name) for name in variables)


def describe(source: str, name: str) -> str:
    return f"""
        SELECT count(*) AS company_count, round(avg({name}), 6) AS mean,
               round(stddev_samp({name}), 6) AS standard_deviation, min({name}) AS minimum,
               round(quantile_cont({name}, 0.25)::DOUBLE, 6) AS p25,
               round(quantile_cont({name}, 0.5)::DOUBLE, 6) AS p50,
               round(quantile_cont({name}, 0.75)::DOUBLE, 6) AS p75, max({name}) AS maximum
        FROM {source} WHERE {name} > 0"""


def stats(source: str, name: str) -> str:
    return f"""
        SELECT mean, p50 AS median, p25, p50, p75, standard_deviation
        FROM ({describe(source, name)})"""


def cut(source: str, name: str) -> str:
    q = STUDY.truncation_quantile
    return f"""(
        SELECT {name} FROM (
            SELECT {name}, row_number() OVER (ORDER BY {name}) AS place, count(*) OVER () AS n
            FROM {source} WHERE {name} > 0)
        WHERE place = ceil({q}::DOUBLE * (n - 1))::BIGINT + 1)"""


def histogram(source: str, name: str) -> str:
    return f"""
        SELECT {name}, count(*) AS company_count FROM {source}
        WHERE {name} > 0 AND {name} <= {cut(source, name)} GROUP BY {name}"""


def months(source: str, where: str = "TRUE") -> str:
    return f"""
        SELECT CAST(date_trunc('month', day) AS DATE) AS month, count(*) AS posting_count
        FROM (SELECT job_id, min({parse('post_date')}) AS day FROM {source}
              WHERE job_id IS NOT NULL AND ({parse('post_date')}) IS NOT NULL AND {where}
              GROUP BY job_id)
        GROUP BY 1"""


ROUNDED_COMPOSITION = """sample, role_k1500, employee_firm_count, denominator_employee_firms,
    round(employee_firm_share, 6) AS employee_firm_share, rank,
    round(cumulative_share, 6) AS cumulative_share"""


def check(kind: str, subject: str, violations: str) -> str:
    return (
        f"SELECT '{kind}' AS \"check\", '{subject}' AS subject, ({violations})::BIGINT AS violations, "
        f"({violations}) = 0 AS passed"
    )


def key_checks(source: str, key: str) -> str:
    subject = f"{source}.{key.replace(', ', ' + ')}"
    return " UNION ALL ".join(
        [
            check("key_not_null", subject, f"SELECT count(*) FROM {source} WHERE {any_null(key)}"),
            check("key_unique", subject, surplus(source, key)),
        ]
    )


def any_null(key: str) -> str:
    return " OR ".join(f"{column} IS NULL" for column in key.split(", "))


def surplus(source: str, key: str) -> str:
    return f"SELECT (SELECT count(*) FROM {source}) - (SELECT count(*) FROM (SELECT DISTINCT {key} FROM {source}))"


def profile(source: str, columns: dict[str, str], key: str) -> str:
    def line(subject, data_type, metric, value):
        typed = f"'{data_type}'" if data_type else "CAST(NULL AS VARCHAR)"
        return (
            f"SELECT '{source}' AS table_name, '{subject}' AS subject, {typed} AS data_type, "
            f"'{metric}' AS metric, ({value})::BIGINT AS value"
        )

    label = key.replace(", ", " + ")
    lines = [line("*", None, "row_count", f"SELECT count(*) FROM {source}")]
    lines += [
        line(c, kind, "null_count", f"SELECT count(*) FROM {source} WHERE {c} IS NULL")
        for c, kind in columns.items()
    ]
    lines += [
        line(label, None, "key_null_rows", f"SELECT count(*) FROM {source} WHERE {any_null(key)}"),
        line(label, None, "key_surplus_rows", surplus(source, key)),
    ]
    return " UNION ALL ".join(lines)


def typed(columns: str) -> dict[str, str]:
    kinds = {
        "bigint": ("rcid", "user_id", "position_id", "job_id"),
        "int": ("education_number", "earliest_grad_year", "estimated_birth_year", "age"),
        "double": ("f_prob", "prestige"),
    }
    kind_of = {column: kind for kind, names in kinds.items() for column in names}
    return {c: kind_of.get(c, "string") for c in columns.split(", ")}


def digest(columns: str, seed: int) -> str:
    texts = ", ".join(
        f"coalesce('+' || length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
        for c in columns.split(", ")
    )
    return f"md5(concat_ws('|', {texts}, '{seed}'))"


FIRST_MONTH, LAST_MONTH = STUDY.calendar
FOCAL = f"job_category IN ({CATEGORIES})"
SELECTS = {
    "normalize_country": f"""
        SELECT rcid, hq_country AS hq_country_raw, {country('hq_country')} AS hq_country
        FROM company_ref""",
    "parse_dates": f"""
        SELECT position_id, startdate AS startdate_text, enddate AS enddate_text,
               {parse('startdate')} AS startdate, {parse('enddate')} AS enddate
        FROM user_positions""",
    "parse_dates_trimmed": f"""
        SELECT position_id, startdate AS startdate_text, enddate AS enddate_text,
               {parse('trim(startdate)')} AS startdate, {parse('trim(enddate)')} AS enddate
        FROM user_positions""",
    "active_spells": f"""
        SELECT {SPELL} FROM user_positions
        WHERE {active(parse('startdate'), parse('enddate'), 'enddate')}""",
    "filter_focal_category": f"SELECT position_id, job_category FROM user_positions WHERE {FOCAL}",
    "filter_period": f"""
        SELECT job_id, rcid, post_date FROM postings_indeed
        WHERE {parse('post_date')} BETWEEN DATE '{FIRST}' AND DATE '{LAST}'""",
    "focal_active_spells": f"""
        SELECT {SPELL} FROM user_positions
        WHERE {FOCAL} AND {active(parse('startdate'), parse('enddate'), 'enddate')}""",
    "active_user_firms": "SELECT rcid, user_id FROM pairs",
    "posting_keys": "SELECT source, job_id, rcid FROM job_keys",
    "firm_employee_counts": "SELECT * FROM employees",
    "firm_posting_counts": "SELECT * FROM postings",
    "active_firms": "SELECT * FROM activity",
    "active_by_country": by_country("activity", "active_firm"),
    "extract_companies": f"SELECT {COMPANY} FROM companies",
    "extract_positions": "SELECT * FROM focal_positions",
    "extract_postings_linkedin": "SELECT * FROM focal_linkedin",
    "extract_postings_indeed": "SELECT * FROM focal_indeed",
    "extract_summary": """
        SELECT 'companies' AS extract, count(*) AS row_count FROM companies
        UNION ALL SELECT 'user_positions', count(*) FROM focal_positions
        UNION ALL SELECT 'postings_linkedin', count(*) FROM focal_linkedin
        UNION ALL SELECT 'postings_indeed', count(*) FROM focal_indeed""",
    "company_total": f"""
        SELECT count(DISTINCT rcid) AS company_total FROM company_ref
        WHERE rics_k400 IN ({INDUSTRIES})""",
    "companies_by_country": by_country("universe"),
    "positive_firms": "SELECT * FROM employees WHERE employee_count > 0",
    "employing_by_country": by_country("employees", "employee_count > 0"),
    "posting_by_country": by_country("postings", "posting_count > 0"),
    "top_countries": f"""
        SELECT * FROM ({by_country('universe')})
        ORDER BY company_count DESC, hq_country LIMIT {STUDY.top_countries}""",
    "date_diagnostics_positions": dates(
        "focal_positions", "user_positions", ["startdate", "enddate"]
    ),
    "date_diagnostics_postings": dates("focal_linkedin", "postings_linkedin", ["post_date"])
    + " UNION ALL "
    + dates("focal_indeed", "postings_indeed", ["post_date"]),
    "date_diagnostics_trimmed": dates(
        "focal_positions", "user_positions", ["startdate", "enddate"], strip=True
    ),
    "date_diagnostics_report": f"""
        SELECT dataset, variable, nonmissing_string_count, failed_conversion_count,
               round(100 * failed_conversion_count::DOUBLE / nonmissing_string_count, 6)
                   AS failed_conversion_percent
        FROM ({dates('focal_positions', 'user_positions', ['startdate', 'enddate'])})""",
    "firm_focal_counts": "SELECT * FROM focal_employees",
    "firm_size_stats": stats("employees", "employee_count"),
    "focal_size_stats": stats("focal_employees", "focal_employee_count"),
    "firm_size_describe": describe("employees", "employee_count"),
    "truncation_cutoff": f"""
        SELECT {cut('employees', 'employee_count')} AS truncation_value,
               count(*) AS company_count,
               count(*) FILTER (WHERE employee_count > {cut('employees', 'employee_count')})
                   AS number_truncated
        FROM employees WHERE employee_count > 0""",
    "truncated_histogram": histogram("employees", "employee_count"),
    "focal_histogram": histogram("focal_employees", "focal_employee_count"),
    "primary_roles": "SELECT * FROM primaries",
    "primary_roles_by_number": "SELECT * FROM primaries",
    "overlap_counts": "SELECT * FROM role_overlaps",
    "role_selection_diagnostics": """
        SELECT metric, value, CASE WHEN metric <> 'active_focal_position_rows'
               THEN round(value::DOUBLE / (SELECT count(*) FROM primaries), 6) END
               AS share_of_employee_firm_pairs
        FROM (
            SELECT 'active_focal_position_rows' AS metric, count(*) AS value FROM role_spells
            UNION ALL SELECT 'active_focal_employee_firm_pairs', count(*) FROM primaries
            UNION ALL SELECT 'employee_firm_pairs_with_multiple_roles',
                count(*) FILTER (WHERE role_count > 1) FROM role_overlaps
            UNION ALL SELECT 'employee_firm_pairs_with_multiple_categories',
                count(*) FILTER (WHERE category_count > 1) FROM role_overlaps
            UNION ALL SELECT 'employee_firm_pairs_with_missing_primary_role',
                count(*) FILTER (WHERE role_k1500 = 'Missing') FROM primaries)""",
    "role_composition": f"SELECT {ROUNDED_COMPOSITION} FROM composition",
    "role_concentration": """
        SELECT sample, employee_firm_count, distinct_role_count, round(t5, 6) AS top_5_share,
               round(t10, 6) AS top_10_share, round(t20, 6) AS top_20_share,
               round(h, 6) AS herfindahl_index, round(1 / h, 6) AS effective_role_count
        FROM (
            SELECT sample, max(denominator_employee_firms) AS employee_firm_count,
                   count(*) AS distinct_role_count,
                   sum(employee_firm_share) FILTER (WHERE rank <= 5) AS t5,
                   sum(employee_firm_share) FILTER (WHERE rank <= 10) AS t10,
                   sum(employee_firm_share) FILTER (WHERE rank <= 20) AS t20,
                   sum(power(employee_firm_share, 2)) AS h
            FROM composition GROUP BY sample)""",
    "top_roles_overall": f"""
        SELECT {ROUNDED_COMPOSITION} FROM composition
        WHERE sample = '{STUDY.all_sample}' AND rank <= {STUDY.top_roles}""",
    "top_roles_by_category": f"""
        SELECT {ROUNDED_COMPOSITION} FROM composition
        WHERE sample IN ({CATEGORIES}) AND rank <= {STUDY.top_roles_per_category}""",
    "monthly_postings_indeed": months("focal_indeed"),
    "monthly_focal_postings_indeed": months("focal_indeed", FOCAL),
    "monthly_postings_linkedin": months("focal_linkedin"),
    "monthly_focal_postings_linkedin": months("focal_linkedin", FOCAL),
    "monthly_series_filled": f"""
        SELECT c.month, m.posting_count
        FROM (SELECT CAST(unnest(generate_series(DATE '{FIRST_MONTH}', DATE '{LAST_MONTH}',
                     INTERVAL 1 MONTH)) AS DATE) AS month) c
        LEFT JOIN ({months('focal_linkedin', FOCAL)}) m ON c.month = m.month""",
    "universe_industries": "SELECT DISTINCT rics_k50, rics_k400 FROM company_ref",
    "universe_roles": "SELECT DISTINCT job_category, role_k1500 FROM user_positions",
    "universe_geography": "SELECT DISTINCT region, country FROM user_positions",
    "project_columns": f"SELECT {SPELL} FROM user_positions",
    "profile_table": " UNION ALL ".join(
        [
            profile("company_ref", typed(COMPANY), "rcid"),
            profile("user_positions", typed(POSITION), "position_id"),
            profile("postings_linkedin", typed(POSTING), "job_id"),
            profile("postings_indeed", typed(POSTING), "job_id"),
            profile("user_education", typed(EDUCATION), "user_id, education_number"),
            profile("user_age", typed(AGE), "user_id"),
            profile("user_demography", typed(DEMOGRAPHY), "user_id"),
        ]
    ),
    "sample_random": f"""
        SELECT {SPELL} FROM user_positions ORDER BY {digest('position_id', 2022)}, {digest(SPELL, 2022)}
        LIMIT {STUDY.sample_size}""",
    "sample_random_age": f"SELECT {AGE} FROM user_age ORDER BY {digest('user_id', 2022)}, {digest(AGE, 2022)} LIMIT {STUDY.sample_size}",
    "sample_random_demography": f"""
        SELECT user_id, fullname, round(f_prob, 6) AS f_prob, round(prestige, 6) AS prestige, user_country
        FROM (SELECT * FROM user_demography ORDER BY {digest('user_id', 2022)}, {digest(DEMOGRAPHY, 2022)} LIMIT {STUDY.sample_size})""",
    "sample_limit_check": f"""
        SELECT least({STUDY.sample_size}, count(*)) AS sample_rows, 0::BIGINT AS strange_rows
        FROM user_positions""",
    "scan_table": "SELECT * FROM company_ref",
    "scan_parquet_columns": "SELECT l_orderkey, l_partkey, l_returnflag FROM lineitem",
    "csv_roundtrip": "SELECT rcid, hq_country FROM company_ref",
    "managed_table_roundtrip": f"SELECT {COMPANY} FROM companies",
    "parquet_export_roundtrip": "SELECT * FROM focal_linkedin",
    "export_dataframe": "SELECT DISTINCT rics_k50, rics_k400 FROM company_ref",
    "check_key": " UNION ALL ".join(
        [
            key_checks("company_ref", "rcid"),
            key_checks("user_positions", "position_id"),
            key_checks("postings_linkedin", "job_id"),
            key_checks("postings_indeed", "job_id"),
            key_checks("user_education", "user_id, education_number"),
            key_checks("user_age", "user_id"),
            key_checks("user_demography", "user_id"),
        ]
    ),
    "check_nonnegative": check(
        "nonnegative", "employee_count", "SELECT count(*) FROM employees WHERE employee_count < 0"
    ),
    "check_one_to_one": check("one_to_one", "companies", surplus("companies", "rcid"))
    + " UNION ALL "
    + check("one_to_one", "user_positions", surplus("user_positions", "rcid")),
    "check_same_universe": check(
        "same_universe",
        "companies",
        "SELECT count(DISTINCT rcid) FROM postings_indeed WHERE rcid NOT IN (SELECT rcid FROM companies)",
    )
    + " UNION ALL "
    + check(
        "same_universe",
        "postings_indeed",
        "SELECT count(*) FROM companies WHERE rcid NOT IN (SELECT rcid FROM postings_indeed)",
    ),
    "reconcile_counts": " UNION ALL ".join(
        check(
            "group_sum",
            name,
            f"SELECT abs((SELECT sum(company_count) FROM ({by_country(source, where)})) - "
            f"(SELECT count(*) FROM {source} WHERE {where}))",
        )
        for name, source, where in (
            ("companies_by_country", "universe", "TRUE"),
            ("employing_by_country", "employees", "employee_count > 0"),
            ("posting_by_country", "postings", "posting_count > 0"),
            ("active_by_country", "activity", "active_firm"),
        )
    ),
}

# Results of a whole report, by the query that makes the same rows.
REPORT = {
    name: name
    for name in (
        "companies_by_country", "firm_employee_counts", "firm_posting_counts", "firm_focal_counts",
        "active_firms", "employing_by_country", "posting_by_country", "active_by_country",
        "role_composition", "role_concentration", "role_selection_diagnostics",
        "date_diagnostics_positions", "date_diagnostics_trimmed",
    )
} | {
    "employee_count_description": "firm_size_describe",
    "employee_count_cutoff": "truncation_cutoff",
    "employee_count_histogram": "truncated_histogram",
    "focal_employee_count_description": "focal_size_stats",
    "focal_employee_count_cutoff": "truncation_cutoff",
    "focal_employee_count_histogram": "focal_histogram",
    "date_diagnostics_postings": "date_diagnostics_postings",
    "monthly_postings_linkedin": "monthly_postings_linkedin",
    "monthly_focal_postings_linkedin": "monthly_focal_postings_linkedin",
    "monthly_postings_indeed": "monthly_postings_indeed",
    "monthly_focal_postings_indeed": "monthly_focal_postings_indeed",
}


def counted(label: str, selects: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS {label}, count(*) AS row_count FROM ({select})" for name, select in selects.items()
    )


SELECTS["date_diagnostics_in_passing"] = " UNION ALL ".join(
    f"""
    SELECT '{reading}' AS reading, d.*, (
        SELECT count(*) FROM focal_positions
        WHERE {active(parse('trim(startdate)'), parse('trim(enddate)'), 'enddate')}) AS running_spells
    FROM ({SELECTS[name]}) d"""
    for reading, name in (("strict", "date_diagnostics_positions"), ("trimmed", "date_diagnostics_trimmed"))
)
SELECTS["employees_by_level"] = """
    SELECT CASE WHEN grouping(rcid) = 0 THEN 'firm' WHEN grouping(hq_country) = 0 THEN 'country' ELSE 'all' END AS level,
           hq_country, rcid, count(DISTINCT user_id) AS employee_count
    FROM (SELECT u.rcid, u.hq_country, p.user_id FROM pairs p JOIN universe u ON p.rcid = u.rcid WHERE p.user_id IS NOT NULL)
    GROUP BY GROUPING SETS ((hq_country, rcid), (hq_country), ())"""
SELECTS["extraction_run"] = counted(
    "extract",
    {
        "company_ref": "SELECT * FROM companies",
        "user_positions": "SELECT * FROM focal_positions",
        "postings_linkedin": "SELECT * FROM focal_linkedin",
        "postings_indeed": "SELECT * FROM focal_indeed",
    },
)
SELECTS["report_run"] = counted("result", {name: SELECTS[query] for name, query in REPORT.items()})

ORACLE = {name: with_blocks(select) for name, select in SELECTS.items()}
