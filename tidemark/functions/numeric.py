"""Rounding and number-to-text expressions that do not depend on the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: Column | str, digits: int) -> Column:
    """Round half up on the double itself, without going through decimal text."""
    scale = float(10**digits)
    return F.floor(as_col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def fixed(c: Column | str, digits: int) -> Column:
    """Text with exactly ``digits`` decimals."""
    if digits == 0:
        return F.floor(as_col(c) + F.lit(0.5)).cast("string")
    return rnd(c, digits).cast(f"decimal(38,{digits})").cast("string")


def plain(c: Column | str) -> Column:
    """Shortest plain decimal text up to six places, at least one (``2.0``, ``0.125``)."""
    text = rnd(c, 6).cast("decimal(38,6)").cast("string")
    return F.regexp_replace(text, r"(\.\d+?)0+$", "$1")


def exact_text(c: Column | str) -> Column:
    """Plain decimal text with up to 15 places (never scientific notation)."""
    text = as_col(c).cast("decimal(38,15)").cast("string")
    return F.regexp_replace(text, r"(\.\d+?)0+$", "$1")


def grouped_text(c: Column | str) -> Column:
    """``1234.5`` -> ``1,234.5``: thousands separators, at most two decimals, zeros trimmed."""
    value = rnd(c, 2)
    text = F.rtrim(F.rtrim(F.format_number(value, 2), F.lit("0")), F.lit("."))
    return text


def pct_change(new: Column | str, old: Column | str) -> Column:
    """Percent change relative to the size of the old value, 0 when the old value is 0."""
    new, old = as_col(new), as_col(old)
    return F.when(old == 0, F.lit(0.0)).otherwise((new - old) / F.abs(old) * 100)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Exact seconds (with fraction) between two zone-less timestamps."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1e6)


def whole_days(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("DAY", earlier, later)


def lookup(key: Column, table: dict) -> Column:
    """Fixed dictionary as a map literal; missing keys give null."""
    parts = [F.lit(x) for pair in table.items() for x in pair]
    return F.create_map(*parts)[key]


def text_array(parts: list[Column]) -> Column:
    """Non-null texts as an array, by joining and splitting (stays in generated code)."""
    joined = F.concat_ws("\u0001", *parts)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, "\u0001"))
