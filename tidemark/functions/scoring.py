"""Data-quality sub-scores, weighted total, routing gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.numeric import lookup, plain, rnd


def bound(indicator: Column, unit: Column, side: int) -> Column:
    """Lower (0) or upper (1) bound: the indicator's own if it has one, else the unit's (null = open)."""
    own = lookup(indicator, {k: v[side] for k, v in K.INDICATOR_BOUNDS.items()})
    by_unit = lookup(unit, {k: v[side] for k, v in K.UNIT_BOUNDS.items() if v[side] is not None})
    return F.coalesce(own, by_unit)


def accuracy(value: Column, low: Column, high: Column) -> tuple[Column, list[Column]]:
    reasons = [
        F.when(value.isNull(), F.lit("value_not_parseable")),
        F.when(value < low, F.concat(F.lit("value_"), plain(value), F.lit("_below_min_"), plain(low))),
        F.when(value > high, F.concat(F.lit("value_"), plain(value), F.lit("_above_max_"), plain(high))),
    ]
    score = (
        F.when(value.isNull(), F.lit(0.0))
        .when((value < low) | (value > high), F.lit(20.0))
        .otherwise(F.lit(100.0))
    )
    return score, reasons


def completeness(fields: dict[str, Column]) -> tuple[Column, list[Column]]:
    lost = F.lit(0.0)
    reasons = []
    for name, c in fields.items():
        missing = c.isNull() | F.trim(c).isin(K.MISSING_FIELD_TOKENS)
        lost = lost + F.when(missing, F.lit(100.0 / len(fields))).otherwise(F.lit(0.0))
        reasons.append(F.when(missing, F.lit(f"missing_{name}")))
    return F.lit(100.0) - lost, reasons


def period_year(period: Column) -> Column:
    """First run of four digits as a year, null when there is none."""
    return F.regexp_extract(F.coalesce(period, F.lit("")), r"(\d{4})", 1).try_cast("int")


def timeliness(year: Column, years_old: Column, age_days: Column) -> tuple[Column, list[Column]]:
    score = (
        F.when(year.isNull(), F.lit(70.0))
        .when(years_old > K.STALE_YEARS, F.lit(50.0))
        .when(age_days > K.SLOW_CRAWL_DAYS, F.lit(70.0))
        .otherwise(F.lit(100.0))
    )
    reason = (
        F.when(year.isNull(), F.lit("period_format_unrecognized"))
        .when(
            years_old > K.STALE_YEARS,
            F.concat(F.lit("data_"), years_old.cast("string"), F.lit("_years_old")),
        )
        .when(
            age_days > K.SLOW_CRAWL_DAYS,
            F.concat(F.lit("crawled_"), age_days.cast("string"), F.lit("_days_ago")),
        )
    )
    return score, [reason]


def consistency(unit: Column, raw_unit: Column) -> tuple[Column, list[Column]]:
    no_unit = F.coalesce(unit, F.lit("")) == ""
    stated = F.coalesce(raw_unit, F.lit(""))
    mentions_pct = F.lower(stated).rlike("(" + "|".join(K.PCT_UNIT_WORDS) + ")")
    clash = ~F.trim(stated).isin("", "None") & (unit == "PCT") & ~mentions_pct
    score = F.when(no_unit, F.lit(50.0)).when(clash, F.lit(60.0)).otherwise(F.lit(100.0))
    reason = F.when(no_unit, F.lit("missing_standard_unit")).when(
        clash, F.concat(F.lit("unit_mismatch_raw="), raw_unit, F.lit("_expected_PCT"))
    )
    return score, [reason]


def weighted_total(acc: Column, comp: Column, time: Column, cons: Column) -> Column:
    w = K.DQ_WEIGHTS
    return rnd(
        acc * F.lit(w["accuracy"]) + comp * F.lit(w["completeness"])
        + time * F.lit(w["timeliness"]) + cons * F.lit(w["consistency"]),
        2,
    )


def dq_status(score: Column) -> Column:
    return (
        F.when(score >= K.DQ_PROMOTE, F.lit("AUTO_PROMOTED"))
        .when(score >= K.DQ_REVIEW, F.lit("REVIEW"))
        .otherwise(F.lit("REJECTED"))
    )


def confidence_decision(confidence: Column) -> Column:
    return (
        F.when(confidence >= K.CONFIDENCE_ACCEPT, F.lit("AUTO_ACCEPT"))
        .when(confidence >= K.CONFIDENCE_REVIEW, F.lit("QUEUE_REVIEW"))
        .otherwise(F.lit("REJECT"))
    )


def oversight_decision(score: Column) -> Column:
    """Stricter than the routing gate: exactly 90 still goes to a person."""
    return (
        F.when(score > K.DQ_PROMOTE, F.lit("AUTO_APPROVED"))
        .when(score >= K.DQ_REVIEW, F.lit("PENDING_REVIEW"))
        .otherwise(F.lit("REJECTED"))
    )


def sla_tier(indicator: Column) -> Column:
    """Exact code first, then the first listed code it starts with, else the last tier."""
    tier = F.lit("TIER3")
    listed = [(code, t) for t, codes in K.SLA_TIERS.items() for code in codes]
    for code, t in reversed(listed):
        tier = F.when(indicator.startswith(code), F.lit(t)).otherwise(tier)
    return F.coalesce(lookup(indicator, dict(listed)), tier)
