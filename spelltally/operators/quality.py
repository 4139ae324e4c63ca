"""Data-quality reports, and a way to stop on a failed one.

Every check gives rows of (check, subject, violations, passed), so that reports can be
put together with ``unionByName`` and written like any other result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spelltally.functions.dates import parse_date
from spelltally.functions.numbers import percent, ratio_or_zero
from spelltally.functions.text import has_text


def _rows(figures: DataFrame, checks: Iterable[tuple[str, str, Column]]) -> DataFrame:
    """Turn a one-row frame of figures into report rows."""
    return figures.select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(check).alias("check"),
                        F.lit(subject).alias("subject"),
                        violations.cast("long").alias("violations"),
                        (violations == 0).alias("passed"),
                    )
                    for check, subject, violations in checks
                )
            )
        )
    )


def _any_null(key: tuple[str, ...]) -> Column:
    null = F.col(key[0]).isNull()
    for name in key[1:]:
        null = null | F.col(name).isNull()
    return null


def key_figures(frame: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """One row: rows with a null in the key, and rows beyond the first of each key."""
    return (
        frame.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .agg(
            F.coalesce(F.sum(F.when(_any_null(key), F.col("_rows"))), F.lit(0)).alias("nulls"),
            F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("surplus"),
        )
    )


def check_key(frame: DataFrame, key: str | tuple[str, ...], subject: str) -> DataFrame:
    """The key is never null and never repeated."""
    key = (key,) if isinstance(key, str) else key
    return _rows(
        key_figures(frame, key),
        [
            ("key_not_null", subject, F.col("nulls")),
            ("key_unique", subject, F.col("surplus")),
        ],
    )


def check_nonnegative(frame: DataFrame, column: str, subject: str) -> DataFrame:
    return _rows(
        frame.agg(F.count_if(F.col(column) < 0).alias("negative")),
        [("nonnegative", subject, F.col("negative"))],
    )


def check_one_to_one(
    left: DataFrame, right: DataFrame, key: str, subjects: tuple[str, str]
) -> DataFrame:
    """Both sides of a join hold each key once."""
    sides = [
        _rows(key_figures(side, (key,)), [("one_to_one", subject, F.col("surplus"))])
        for side, subject in zip((left, right), subjects)
    ]
    return sides[0].unionByName(sides[1])


def check_same_universe(
    left: DataFrame, right: DataFrame, key: str, subjects: tuple[str, str]
) -> DataFrame:
    """Both sides hold the same keys; counts the keys each side lacks."""
    marked = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    figures = (
        marked.groupBy(key)
        .agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
        .agg(
            F.count_if(F.col("_l") == 0).alias("left_lacks"),
            F.count_if(F.col("_r") == 0).alias("right_lacks"),
        )
    )
    return _rows(
        figures,
        [
            ("same_universe", subjects[0], F.col("left_lacks")),
            ("same_universe", subjects[1], F.col("right_lacks")),
        ],
    )


def check_group_sum(
    groups: DataFrame, count: str, members: DataFrame, subject: str
) -> DataFrame:
    """Group counts add up to the number of members."""
    parts = groups.agg(F.sum(count).alias("_n")).unionByName(
        members.agg((-F.count(F.lit(1))).alias("_n"))
    )
    return _rows(
        parts.agg(F.abs(F.coalesce(F.sum("_n"), F.lit(0))).alias("gap")),
        [("group_sum", subject, F.col("gap"))],
    )


def check_group_sums(
    members: DataFrame, key: str, by: str, groupings: dict[str, Column]
) -> DataFrame:
    """:func:`check_group_sum` for several groupings of one frame.

    ``groupings`` tells by name which members a grouping counts. Groups and totals come
    from one aggregate, so the frame is used once.
    """
    flags = {f"_held_{i}": held for i, held in enumerate(groupings.values())}
    counted = (
        members.select(key, by, *(held.alias(flag) for flag, held in flags.items()))
        .rollup(by)
        .agg(
            F.grouping(by).alias("_total"),
            *(F.count(F.when(F.col(flag), F.col(key))).alias(f"_n{flag}") for flag in flags),
            *(F.count_if(F.col(flag)).alias(f"_rows{flag}") for flag in flags),
        )
    )
    signed = (
        F.sum(F.when(F.col("_total") == 1, -F.col(f"_rows{flag}")).otherwise(F.col(f"_n{flag}"))).alias(flag)
        for flag in flags
    )
    return _rows(
        counted.agg(*signed),
        [("group_sum", name, F.abs(F.coalesce(F.col(flag), F.lit(0)))) for name, flag in zip(groupings, flags)],
    )


def enforce(report: DataFrame) -> None:
    """Raise when a check failed. A report has a handful of rows."""
    failed = report.where(~F.col("passed")).collect()
    if failed:
        raise ValueError(
            "; ".join(f"{r['check']} of {r['subject']}: {r['violations']} violations" for r in failed)
        )


def date_diagnostics(
    frame: DataFrame,
    dataset: str,
    *variables: str,
    parse: Callable[[Column], Column] = parse_date,
) -> DataFrame:
    """Per date variable: rows, missing, present and unreadable values; one pass for all."""
    return date_diagnostics_by(frame, dataset, *variables, readings={"": parse}).drop("reading")


def date_diagnostics_by(
    frame: DataFrame, dataset: str, *variables: str, readings: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """:func:`date_diagnostics` for several ways to read a date, named in ``reading``; one pass."""
    return _date_rows(frame.agg(*_date_figures(variables, readings)), dataset, variables, list(readings))


def dates_in_passing(
    frame: DataFrame,
    dataset: str,
    *variables: str,
    readings: dict[str, Callable[[Column], Column]],
    read: Callable[[str, str], str] | None = None,
) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """The frame, and its :func:`date_diagnostics_by` once a job has gone through it.

    The first action on the returned frame must go through all of its rows, and may filter,
    project and write them, without a shuffle in between: only tasks of a job's last stage
    count each row once even when an executor is lost and work is repeated. The diagnostics
    wait for that action. ``read`` names the column that holds a variable's dates by a reading,
    where the frame has them parsed.
    """
    seen = Observation()
    figures = _date_figures(variables, readings, read)
    names = [name for name, _ in _figure_names(variables, readings)]

    def diagnostics() -> DataFrame:
        # An empty frame is optimised away together with its figures.
        counted = [int(seen.get.get(name) or 0) for name in names]
        row = frame.sparkSession.createDataFrame([tuple(counted)], ", ".join(f"`{name}` long" for name in names))
        return _date_rows(row, dataset, variables, list(readings))

    return frame.observe(seen, *figures), diagnostics


def _figure_names(
    variables: Iterable[str],
    readings: dict[str, Callable[[Column], Column]],
    read: Callable[[str, str], str] | None = None,
) -> list[tuple[str, Column]]:
    """Names and aggregates of what date diagnostics are made from."""
    figures = [("rows", F.count(F.lit(1)))]
    for name in variables:
        text = F.col(name)
        present = has_text(text)
        figures.append((f"{name}_present", F.count_if(present)))
        figures += [
            (f"{name}_failed_{reading}", F.count_if(present & (F.col(read(name, reading)) if read else parse(text)).isNull()))
            for reading, parse in readings.items()
        ]
    return figures


def _date_figures(
    variables: Iterable[str],
    readings: dict[str, Callable[[Column], Column]],
    read: Callable[[str, str], str] | None = None,
) -> list[Column]:
    return [figure.alias(name) for name, figure in _figure_names(variables, readings, read)]


def _date_rows(figures: DataFrame, dataset: str, variables: Iterable[str], readings: list[str]) -> DataFrame:
    """Rows per reading and variable from one row of figures."""

    # Fixed names: the columns of the date report.
    def row(reading: str, name: str) -> Column:
        present, failed = F.col(f"{name}_present"), F.col(f"{name}_failed_{reading}")
        return F.struct(
            F.lit(reading).alias("reading"),
            F.lit(dataset).alias("dataset"),
            F.lit(name).alias("variable"),
            F.col("rows").alias("row_count"),
            (F.col("rows") - present).alias("missing_or_blank_count"),
            present.alias("nonmissing_string_count"),
            failed.alias("failed_conversion_count"),
            ratio_or_zero(failed, present).alias("failed_conversion_share"),
        )

    return figures.select(F.inline(F.array(*(row(reading, name) for reading in readings for name in variables))))


def date_report(diagnostics: DataFrame) -> DataFrame:
    """The diagnostics as printed: counts and the failed share in percent."""
    return diagnostics.select(
        "dataset",
        "variable",
        "nonmissing_string_count",
        "failed_conversion_count",
        percent(F.col("failed_conversion_share")).alias("failed_conversion_percent"),
    )


def profile_table(frame: DataFrame, table: str, key: tuple[str, ...]) -> DataFrame:
    """Rows, nulls per column with its type, and whether the declared key holds.

    Null counts and key figures are two scans: together, each counter would travel
    with every key through the shuffle.
    """

    def line(subject: str, data_type: str | None, metric: str, value: Column) -> Column:
        return F.struct(
            F.lit(table).alias("table_name"),
            F.lit(subject).alias("subject"),
            F.lit(data_type).cast("string").alias("data_type"),
            F.lit(metric).alias("metric"),
            value.cast("long").alias("value"),
        )

    nulls = frame.agg(
        F.count(F.lit(1)).alias("_rows"),
        *(F.count_if(F.col(c).isNull()).alias(f"_null_{i}") for i, c in enumerate(frame.columns)),
    ).select(
        F.inline(
            F.array(
                line("*", None, "row_count", F.col("_rows")),
                *(
                    line(f.name, f.dataType.simpleString(), "null_count", F.col(f"_null_{i}"))
                    for i, f in enumerate(frame.schema.fields)
                ),
            )
        )
    )
    label = " + ".join(key)
    keys = key_figures(frame, key).select(
        F.inline(
            F.array(
                line(label, None, "key_null_rows", F.col("nulls")),
                line(label, None, "key_surplus_rows", F.col("surplus")),
            )
        )
    )
    return nulls.unionByName(keys)
