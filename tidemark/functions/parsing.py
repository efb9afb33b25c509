"""Raw value text -> number, forecast flag, unit log, record validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.numeric import as_col, lookup, text_array


def _any_word(text: Column, words: list[str]) -> Column:
    """One scan of ``text`` for any of ``words`` (plain substrings, escaped for the regex)."""
    escaped = [w.replace("%", r"\%").replace(".", r"\.") for w in words]
    return text.rlike("(" + "|".join(escaped) + ")")


def cleaned(raw_value: Column) -> Column:
    return F.regexp_replace(F.lower(raw_value), r"[,$€£¥%\s]", "")


def scale_mark(raw: Column, original: Column, strict: bool = False) -> Column:
    """Scale letter t / b / m of a cleaned text, null when it has none."""
    tail = r"\d{}$" if strict else "{}$"
    words = F.lower(original)

    def says(mark: str, word: str) -> Column:
        return raw.rlike(tail.format(mark)) | words.contains(word)

    return (
        F.when(says("t", "trillion"), "t").when(says("b", "billion"), "b").when(says("m", "million"), "m")
    )


def scaled_number(raw: Column, mark: Column, unit: Column) -> Column:
    """Number left in a cleaned text, brought to the standard unit's scale."""
    body = F.coalesce(F.rtrim(raw, mark), raw)
    number = F.regexp_replace(body, r"[^\d.\-]", "").try_cast("double")
    factor = F.when(mark == "t", F.lit(1000.0)).when(mark == "m", F.lit(0.001)).otherwise(F.lit(1.0))
    bare = F.when(mark.isNull(), unit)
    return repair_scale(number * factor, bare)


def parse_value(raw_value: Column | str, unit: Column | str, strict_suffix: bool = False) -> Column:
    """Number in the standard unit's scale, or null.

    By default any trailing t/b/m counts as trillion/billion/million, so
    ``"2.5 percent"`` reads as 2500; ``strict_suffix`` asks for a digit before it.
    """
    original, unit = as_col(raw_value), as_col(unit)
    raw = cleaned(original)
    return scaled_number(raw, scale_mark(raw, original, strict_suffix), unit)


def with_value(df, raw_value: str = "raw_value", unit: str = "standard_unit", strict_suffix: bool = False):
    """``value`` column in stages, so that each intermediate is written once in the plan."""
    c = F.col
    return (
        df.withColumn("_raw", cleaned(c(raw_value)))
        .withColumn("_mark", scale_mark(c("_raw"), c(raw_value), strict_suffix))
        .withColumn("value", scaled_number(c("_raw"), c("_mark"), c(unit)))
        .drop("_raw", "_mark")
    )


def repair_scale(value: Column, unit: Column, magnitude: bool = True) -> Column:
    """Bring bare absolute amounts down to billions / millions."""
    size = F.abs(value) if magnitude else value
    divisor = F.lit(1.0)
    for name, threshold in K.UNIT_SCALE_RULES:
        divisor = F.when((unit == name) & (size >= threshold), F.lit(threshold)).otherwise(divisor)
    return value / divisor


def is_forecast(raw_value: Column | str) -> Column:
    return F.coalesce(_any_word(F.lower(as_col(raw_value)), K.FORECAST_WORDS_RAW), F.lit(False))


def conversion_note(value: Column, raw_unit: Column, unit: Column) -> Column:
    changed = value.isNotNull() & (F.coalesce(raw_unit, F.lit("")) != "") & ~raw_unit.eqNullSafe(unit)
    return F.when(
        changed,
        F.concat(F.lit("unit_converted:"), raw_unit, F.lit("->"), F.coalesce(unit, F.lit(""))),
    )


def standard_unit(indicator: Column | str) -> Column:
    return lookup(as_col(indicator), {code: meta[2] for code, meta in K.INDICATORS.items()})


def record_errors(country: Column, period: Column, indicator: Column, raw_value: Column) -> Column:
    """Array of the problems of one raw record, empty when it is clean."""
    def shown(c: Column) -> Column:
        return F.coalesce(c, F.lit("None"))

    return text_array([
        F.when(
            ~F.coalesce(country.rlike(K.ISO3), F.lit(False)),
            F.concat(F.lit("invalid_country_code: "), shown(country)),
        ),
        F.when(
            ~F.coalesce(period.rlike(K.PERIOD), F.lit(False)),
            F.concat(F.lit("invalid_period: "), shown(period)),
        ),
        F.when(
            ~F.coalesce(indicator.isin(K.RAW_RECORD_INDICATORS), F.lit(False)),
            F.concat(F.lit("unknown_indicator: "), shown(indicator)),
        ),
        F.when(raw_value.isNull() | raw_value.isin(K.MISSING_RAW_VALUES), F.lit("missing_raw_value")),
    ])
