"""Period strings (``YYYY``, ``YYYY-MM``, ``YYYY-Qn``, ``YYYY-MM-DD``) to dates and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quarter(period: Column) -> tuple[Column, Column]:
    return (
        F.regexp_extract(period, r"^(\d{4})-Q([1-4])$", 1),
        F.regexp_extract(period, r"^(\d{4})-Q([1-4])$", 2).try_cast("int"),
    )


def start_date(period: Column) -> Column:
    """First day of the period, used to place points on a time axis."""
    year, quarter = _quarter(period)
    text = (
        F.when(F.length(period) == 4, F.concat(period, F.lit("-01-01")))
        .when(
            quarter.isNotNull(),
            F.concat(year, F.lit("-"), F.lpad((quarter * 3 - 2).cast("string"), 2, "0"), F.lit("-01")),
        )
        .when(F.length(period) == 7, F.concat(period, F.lit("-01")))
        .otherwise(period)
    )
    return text.try_cast("date")


def end_key(period: Column) -> Column:
    """Text key of the period's end; compared with a date text to find future periods."""
    year, quarter = _quarter(period)
    return (
        F.when(F.length(period) == 4, F.concat(period, F.lit("-12-31")))
        .when(
            quarter.isNotNull(),
            F.concat(year, F.lit("-"), F.lpad((quarter * 3).cast("string"), 2, "0"), F.lit("-28")),
        )
        .otherwise(F.substring(period, 1, 10))
    )


def label(day: Column, frequency: str) -> Column:
    """Date -> period text at the given frequency."""
    year = F.year(day).cast("string")
    if frequency == "ANNUAL":
        return year
    if frequency == "QUARTERLY":
        return F.concat(year, F.lit("-Q"), F.quarter(day).cast("string"))
    return F.concat(year, F.lit("-"), F.lpad(F.month(day).cast("string"), 2, "0"))


def in_years(period: Column, first: int | None, last: int | None) -> Column:
    """Lexical range test, correct for all four shapes."""
    test = F.lit(True)
    if first is not None:
        test = test & (period >= str(first))
    if last is not None:
        test = test & (period < str(last + 1))
    return test
