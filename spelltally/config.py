"""Parameters of a study: which industry, which dates, which job categories."""

from __future__ import annotations

from dataclasses import dataclass

MISSING = "Missing"


@dataclass(frozen=True)
class Study:
    """One industry's parameter set. Dates are ISO text; both ends of a range count."""

    name: str
    industries: tuple[str, ...]
    snapshot: str = "2022-12-01"
    period: tuple[str, str] = ("2021-01-01", "2022-12-31")
    calendar: tuple[str, str] = ("2018-01-01", "2025-05-01")
    categories: tuple[str, ...] = ("Scientist", "Engineer")
    role: str = "role_k1500"
    all_sample: str = "All focal employees"
    truncation_quantile: float = 0.975
    top_countries: int = 30
    top_roles: int = 30
    top_roles_per_category: int = 20
    sample_size: int = 1000


# The industry labels which define each company universe.
BIOPHARM = Study(
    name="biopharm",
    industries=(
        "Biotechnology and Life Sciences",
        "Pharmaceutical Manufacturing",
        "Pharmaceuticals",
    ),
)
AUTOMATION = Study(
    name="automation",
    industries=(
        "Automation and Robotics Equipment",
        "Automation and Robotics Solutions",
        "Industrial Automation and Tools",
        "Industrial Automation and Machinery",
    ),
)
ELECTRONICS = Study(
    name="electronics",
    industries=(
        "Semiconductor and Electronics Manufacturing",
        "Electronic Components and Instrumentation",
        "Electronic Components and Equipment Manufacturing",
        "Electronics and Electrical Equipment Manufacturing",
        "Electronic Systems and Components",
    ),
)
STUDIES = {study.name: study for study in (BIOPHARM, AUTOMATION, ELECTRONICS)}

# The study which fits the provided test tables (FIXTURES.md, section 3).
PROVIDED = Study(
    name="provided",
    industries=("BUILDING", "MACHINERY", "AUTOMOBILE"),
    snapshot="1998-12-01",
    period=("1997-01-01", "1998-12-31"),
    calendar=("1994-06-01", "2002-05-01"),
)
