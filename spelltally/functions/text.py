"""Text clean-up with the white-space rule of Python's ``str.strip``.

Each function names its input once: a filter that Catalyst pushes below a projection
copies the projected expression to every place that names it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spelltally.config import MISSING

# Fixed value: the characters Python's str.strip removes, as the body of a character class.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# From the first to the last visible character, line breaks included.
VISIBLE = rf"(?s)[^{SPACE}](?:.*[^{SPACE}])?"


def strip(value: Column) -> Column:
    """Drop white space of any kind at both ends; ``trim`` would drop blanks only."""
    return F.regexp_extract(value.cast("string"), VISIBLE, 0)


def has_text(value: Column) -> Column:
    """True when the value holds at least one visible character; never null."""
    return F.coalesce(value.cast("string").rlike(f"[^{SPACE}]"), F.lit(False))


def blank_to(value: Column, label: str) -> Column:
    """Null and blank text replaced by a label, other text unchanged."""
    return F.regexp_replace(
        F.coalesce(value.cast("string"), F.lit("")), rf"^[{SPACE}]*\z", label
    )


def label_or_missing(value: Column, label: str = MISSING) -> Column:
    """Stripped text, with null and blank replaced by a label."""
    return strip(blank_to(value, label))
