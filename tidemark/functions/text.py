"""Text expressions: numbers in prose, citations, privacy, safety wording, templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.numeric import fixed, grouped_text, lookup, plain


# --- Numbers in prose -------------------------------------------------------

def grouped_numbers(text: Column) -> Column:
    """All numbers of a text, thousands separators understood -> array<double>."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(K.NUMBER_GROUPED), F.lit(0))
    return F.transform(found, lambda t: F.replace(t, F.lit(","), F.lit("")).cast("double"))


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(K.NUMBER_PLAIN), F.lit(0))


def is_significant(token: Column) -> Column:
    """Skips bare years and tiny step numbers."""
    value = token.try_cast("double")
    dotted = token.contains(".")
    year_like = value.between(1900, 2100) & ~dotted
    return F.coalesce(~year_like & ((F.abs(value) >= 0.01) | dotted), F.lit(False))


def claim_numbers(text: Column) -> Column:
    """Plausible indicator values claimed in a response: 0.01 < x < 1000."""
    found = F.regexp_extract_all(text, F.lit(K.NUMBER_CLAIM), F.lit(1))
    values = F.transform(found, lambda t: t.cast("double"))
    return F.filter(values, lambda v: (v > 0.01) & (v < 1000))


def numeric_match(expected: Column, numbers: Column) -> Column:
    """Any number within the absolute or the relative tolerance of the expected value."""
    size = F.greatest(F.abs(expected), F.lit(1e-9))
    return F.exists(
        numbers,
        lambda n: (F.abs(n - expected) <= K.ANSWER_ABS_TOL)
        | (F.abs(n - expected) / size <= K.ANSWER_REL_TOL),
    )


def contains_ci(haystack: Column, needle: Column) -> Column:
    filled = (F.coalesce(needle, F.lit("")) != "") & (F.coalesce(haystack, F.lit("")) != "")
    return filled & F.lower(F.coalesce(haystack, F.lit(""))).contains(F.lower(F.coalesce(needle, F.lit(""))))


def mentions_any(text: Column, words: list[str]) -> Column:
    """Any of the words as a substring, case-insensitive, in one pass over the text."""
    return F.coalesce(F.lower(text).rlike("(" + "|".join(words) + ")"), F.lit(False))


# --- Retrieval scores -------------------------------------------------------

def hit_at_k(expected: Column, retrieved: Column, k: int) -> Column:
    return F.coalesce(F.arrays_overlap(F.slice(retrieved, 1, k), expected), F.lit(False))


def recall_at_k(expected: Column, retrieved: Column, k: int) -> Column:
    """Share of the (distinct) expected ids inside the top k."""
    found = F.size(F.array_intersect(expected, F.slice(retrieved, 1, k)))
    return F.when(F.size(expected) > 0, found / F.size(expected)).otherwise(F.lit(0.0))


# --- Citations --------------------------------------------------------------

def has_citation(text: Column, patterns: list[str] | None = None) -> Column:
    test = F.lit(False)
    for pattern in patterns or K.CITATION_MARKERS:
        test = test | F.coalesce(text.rlike(pattern), F.lit(False))
    return test


def inline_citations(text: Column) -> Column:
    """``[Source: name, period]`` markers -> array<struct<source_name, period>>."""
    names = F.regexp_extract_all(text, F.lit(K.INLINE_CITATION), F.lit(1))
    periods = F.regexp_extract_all(text, F.lit(K.INLINE_CITATION), F.lit(2))
    return F.transform(
        F.arrays_zip(names.alias("n"), periods.alias("p")),
        lambda z: F.struct(F.trim(z["n"]).alias("source_name"), F.trim(z["p"]).alias("period")),
    )


# --- Privacy ----------------------------------------------------------------

def pii_counts(text: Column) -> Column:
    """struct<email, phone, ...> with the number of spans of each type."""
    return F.struct(
        *[F.regexp_count(text, F.lit(p)).alias(name.lower()) for name, p in K.PII_PATTERNS.items()]
    )


def redact(text: Column) -> Column:
    """Replace private spans, one pass per type in a fixed order."""
    out = text
    for name in K.PII_ORDER:
        out = F.regexp_replace(out, K.PII_PATTERNS[name], f"[REDACTED_{name}]")
    return out


def daily_ip_hash(ip: Column, day: Column) -> Column:
    return F.sha2(F.concat(ip, day.cast("string")), 256)


def short_hash(text: Column) -> Column:
    """First 16 hex digits of the content hash."""
    return F.substring(F.sha2(text, 256), 1, 16)


# --- Safety -----------------------------------------------------------------

def with_disclaimer(response: Column) -> Column:
    wanted = mentions_any(response, K.DISCLAIMER_WORDS) & ~response.contains(K.DISCLAIMER)
    return F.when(wanted, F.concat(response, F.lit(K.DISCLAIMER))).otherwise(response)


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.8, F.lit("high")).when(score >= 0.5, F.lit("medium")).otherwise(F.lit("low"))


# --- Quality reasons --------------------------------------------------------

def reason_sentence(reason: Column) -> Column:
    """Reason code -> sentence for a reader."""
    below = F.regexp_extract(reason, r"^value_(.*)_below_min_(.*)$", 1)
    above = F.regexp_extract(reason, r"^value_(.*)_above_max_(.*)$", 1)
    floor = F.regexp_extract(reason, r"^value_(.*)_below_min_(.*)$", 2)
    ceiling = F.regexp_extract(reason, r"^value_(.*)_above_max_(.*)$", 2)
    years = F.regexp_extract(reason, r"^data_(.*)_years_old$", 1)
    days = F.regexp_extract(reason, r"^crawled_(.*)_days_ago$", 1)
    spaced = F.replace(reason, F.lit("_"), F.lit(" "))
    return (
        F.when(lookup(reason, K.REASON_SENTENCES).isNotNull(), lookup(reason, K.REASON_SENTENCES))
        .when(below != "", F.concat(
            F.lit("Value "), below, F.lit(" is below the minimum plausible bound ("), floor, F.lit(").")))
        .when(above != "", F.concat(
            F.lit("Value "), above, F.lit(" exceeds the maximum plausible bound ("), ceiling, F.lit(").")))
        .when(years != "", F.concat(
            F.lit("Data is "), years, F.lit(" years old relative to the current year.")))
        .when(days != "", F.concat(
            F.lit("Record was crawled "), days, F.lit(" days ago (may affect freshness score).")))
        .when(reason.startswith("unit_mismatch"), F.concat(
            F.lit("Unit mismatch detected: "),
            F.replace(reason, F.lit("unit_mismatch_"), F.lit("")), F.lit(".")))
        .otherwise(F.concat(F.upper(F.substring(spaced, 1, 1)), F.lower(F.substr(spaced, F.lit(2)))))
    )


def reason_dimension(reason: Column) -> Column:
    timing = reason.contains("years_old") | reason.startswith("crawled_") | reason.contains("period_format")
    return (
        F.when(reason.startswith("missing_"), F.lit("completeness"))
        .when(reason.startswith("value_"), F.lit("accuracy"))
        .when(timing, F.lit("timeliness"))
        .when(reason.contains("unit"), F.lit("consistency"))
        .otherwise(F.lit("accuracy"))
    )


# --- Templates --------------------------------------------------------------

def value_phrase(value: Column, unit: Column) -> Column:
    """``1,234.5 billion USD`` / ``2.1%``: the way an answer reads."""
    phrase = F.coalesce(lookup(unit, K.UNIT_PHRASES), unit, F.lit(""))
    number = grouped_text(value)
    return F.when(phrase == "%", F.concat(number, F.lit("%"))).otherwise(
        F.trim(F.concat(number, F.lit(" "), phrase))
    )


def record_text(indicator, country, period, value, unit, source, forecast) -> Column:
    """Line that is embedded for a published record."""
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Indicator: "), indicator),
        F.concat(F.lit("Country: "), country),
        F.concat(F.lit("Period: "), period),
        F.concat(F.lit("Value: "), plain(value), F.lit(" "), unit),
        F.concat(F.lit("Source: "), source),
        F.when(forecast, F.lit("Type: forecast/projection")),
    )


def news_text(title: Column, category: Column, content: Column) -> Column:
    return F.concat(
        F.lit("Title: "), title, F.lit("\nCategory: "), category,
        F.lit("\nContent: "), F.substring(content, 1, 1000),
    )


def coverage_notice(name: Column, score: Column) -> Column:
    return F.concat(
        F.lit("Note: Data coverage for "), name, F.lit(" is currently "), fixed(score, 0),
        F.lit("%. Some indicators may be unavailable or sourced from limited providers."),
    )


def diversity_nudge(region: Column, others: Column) -> Column:
    return F.concat(
        F.lit("You've been exploring "), region, F.lit(" data. Consider also looking at "),
        F.array_join(F.slice(others, 1, 2), ", "), F.lit(" indicators for a broader perspective."),
    )
