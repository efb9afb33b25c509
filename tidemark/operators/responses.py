"""Checks over questions and responses: privacy, guardrails, grounding, citations, history."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import text
from tidemark.operators import keyed


# --- Privacy ----------------------------------------------------------------

def redact_table(rows: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Redacted text of every row plus what was found; the original text is not kept."""
    counts = text.pii_counts(F.col(column))
    return rows.withColumn("_c", counts).select(
        key, text.redact(F.col(column)).alias("redacted"),
        *[F.col(f"_c.{name.lower()}").alias(f"n_{name.lower()}") for name in K.PII_PATTERNS],
        F.sha2(column, 256).alias("text_hash"),
    )


def privacy_audit(redacted: DataFrame, key: str) -> DataFrame:
    """Audit rows for texts that held private data: hash and types only."""
    found = F.array_compact(F.array(*[
        F.when(F.col(f"n_{name.lower()}") > 0, F.lit(name)) for name in K.PII_PATTERNS
    ]))
    return redacted.withColumn("_found", found).filter(F.size("_found") > 0).select(
        key, "text_hash", F.array_join("_found", ",").alias("pii_types")
    )


# --- Guardrails -------------------------------------------------------------

def guard(pairs: DataFrame) -> DataFrame:
    """First matching filter decides; otherwise the forecast disclaimer is added where due.

    ``pairs``: query, response (plus any keys).
    """
    verdict = F.when(
        text.mentions_any(F.col("response"), K.ADVICE_WORDS), "InvestmentAdviceFilter"
    ).when(~text.mentions_any(F.col("query"), K.DOMAIN_WORDS), "ScopeFilter")
    keys = [c for c in pairs.columns if c not in ("query", "response")]
    final = (
        F.when(F.col("triggered_filter") == "InvestmentAdviceFilter", F.lit(K.ADVICE_REFUSAL))
        .when(F.col("triggered_filter") == "ScopeFilter", F.lit(K.SCOPE_REFUSAL))
        .otherwise(text.with_disclaimer(F.col("response")))
    )
    return pairs.withColumn("triggered_filter", verdict).select(
        *keys, "triggered_filter", F.col("triggered_filter").isNull().alias("passed"),
        final.alias("final_response"), F.length(final).alias("response_length"),
        F.sha2("query", 256).alias("query_hash"),
    )


# --- Numbers against published values ---------------------------------------

def _log_bucket(value: Column) -> Column:
    return F.floor(F.log(value) / F.log(F.lit(1.1)))


def value_buckets(gold: DataFrame) -> DataFrame:
    """Smallest and largest positive value per geometric bucket of ratio 1.1.

    Only values that a claim between 0.01 and 1000 can reach are kept, so there
    are at most about 125 buckets however many values there are.
    """
    reach = gold.filter((F.col("value") > 0.008) & (F.col("value") < 1101.0))
    return reach.groupBy(_log_bucket(F.col("value")).alias("bucket")).agg(
        F.min("value").alias("low"), F.max("value").alias("high")
    )


def bucket_map(gold: DataFrame) -> Column:
    """The value buckets as one map (bucket -> low, high), a scalar subquery of bounded size."""
    entry = F.struct("bucket", F.struct("low", "high"))
    return value_buckets(gold).agg(F.map_from_entries(F.collect_list(entry))).scalar()


def near_any(x: Column, buckets: Column) -> Column:
    """Some published value lies within 10 % of the number.

    The interval [0.9x, 1.1x] spans two to four buckets. In the first one a value
    lies inside iff the bucket's maximum reaches the lower end, in the last one
    iff its minimum does not pass the upper end, and any bucket between counts
    when it holds a value at all. Exact, and evaluated where the text is: nothing
    is shuffled.
    """
    lo, hi = x * F.lit(0.9), x * F.lit(1.1)
    inside = F.exists(
        F.sequence(_log_bucket(lo), _log_bucket(hi)),
        lambda b: F.coalesce((buckets[b]["high"] >= lo) & (buckets[b]["low"] <= hi), F.lit(False)),
    )
    return inside


def validate_output(rows: DataFrame, gold: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Citation, length and number checks of each response, with a confidence.

    Confidence: 0.8 without numbers, 0.4 when none matches, else 0.2 per matching
    number up to 1. One pass over the texts.
    """
    body = F.col(column)
    read = rows.select(
        key, text.has_citation(body).alias("has_citation"), F.length(body).alias("n_chars"),
        text.claim_numbers(body).alias("_x"), bucket_map(gold).alias("_b"),
    )
    matched = F.filter("_x", lambda x: near_any(x, F.col("_b")))
    counted = read.select(
        key, "has_citation", "n_chars", F.size("_x").cast("bigint").alias("n_numbers"),
        F.size(matched).cast("bigint").alias("n_matched"),
    )
    n, m = F.col("n_numbers"), F.col("n_matched")
    confidence = (
        F.when(n == 0, F.lit(0.8)).when(m == 0, F.lit(0.4)).otherwise(F.least(F.lit(1.0), m / F.lit(5.0)))
    )
    issues = F.array_compact(F.array(
        F.when(~F.col("has_citation"), F.lit("Response missing source citation")),
        F.when(F.col("n_chars") < K.MIN_RESPONSE_CHARS, F.lit("Response too short (< 50 chars)")),
        F.when(F.col("n_chars") > K.MAX_RESPONSE_CHARS, F.lit("Response too long (> 4000 chars)")),
        F.when((n > 0) & (m == 0), F.lit("Numeric values could not be cross-referenced against Gold layer")),
    ))
    return counted.select(
        key, "n_numbers", "n_matched", confidence.alias("confidence"),
        issues.alias("issues"), (F.size(issues) == 0).alias("valid"),
    )


# --- Grounding --------------------------------------------------------------

def grounding(responses: DataFrame, values: DataFrame, key: str, column: str = "text",
              tolerance: float = K.GROUNDING_TOLERANCE) -> DataFrame:
    """Share of a response's numbers that its own retrieved values support.

    Each retrieved value covers an interval around itself. Values close enough to
    share a bucket have overlapping intervals, so they are first merged into one
    interval per (response, bucket): a bounded number however many values a
    response retrieved. A number is then supported iff the furthest interval end
    seen so far, in order of interval start, reaches it: one sort per response
    instead of comparing all pairs. ``values``: key, value.
    """
    tokens = F.filter(text.number_tokens(F.col(column)), text.is_significant)
    # At least one row per response, so that responses without numbers stay in.
    numbers = responses.select(key, F.explode_outer(tokens).alias("token")).select(
        key, F.col("token").cast("double").alias("at"), F.lit(1).alias("kind"),
        F.lit(None).cast("double").alias("reach"), F.lit(0).cast("bigint").alias("n")
    )
    v = F.col("value")
    # A retrieved zero supports numbers strictly below the tolerance.
    radius = F.when(v == 0, F.lit(math.nextafter(tolerance, 0.0))).otherwise(F.greatest(F.lit(tolerance), F.abs(v) * tolerance))
    bucket = F.when(F.abs(v) <= 1, F.floor(v / tolerance)).otherwise(
        F.signum(v).cast("bigint") * (F.floor(F.log(F.abs(v)) / F.log(F.lit(1.0 + tolerance))) + 1_000_000)
    )
    merged = values.filter(v.isNotNull()).groupBy(key, bucket.alias("_bucket")).agg(
        F.min(v - radius).alias("at"), F.max(v + radius).alias("reach"), F.count(F.lit(1)).alias("n")
    )
    cover = merged.select(key, "at", F.lit(0).alias("kind"), "reach", "n")
    sweep = Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    checked = numbers.unionByName(cover).withColumn("_reach", F.max("reach").over(sweep))
    is_number = (F.col("kind") == 1) & F.col("at").isNotNull()
    joined = checked.groupBy(key).agg(
        F.count_if(F.col("kind") == 1).alias("_responses"), F.count_if(is_number).alias("n_numbers"), F.sum("n").alias("n_grounded"),
        F.count_if(is_number & (F.col("_reach").isNull() | (F.col("_reach") < F.col("at")))).alias("_u"),
    ).filter(F.col("_responses") > 0)
    n, g, u = F.col("n_numbers"), F.col("n_grounded"), F.col("_u")
    level = (
        F.when((n > 0) & (g == 0), "low").when((n == 0) | (u == 0), "high")
        .when(u / n >= 0.5, "low").otherwise("medium")
    )
    warning = F.when(
        (n > 0) & (g == 0), F.lit("Response contains numeric claims but no grounded data was retrieved.")
    ).when((n > 0) & (u > 0), F.concat(
        u.cast("string"), F.lit(" of "), n.cast("string"),
        F.lit(" numeric values could not be verified against retrieved data.")))
    return joined.select(
        key, "n_numbers", "n_grounded", F.when(g > 0, u).otherwise(n).alias("n_unmatched"),
        level.alias("confidence"), warning.alias("warning"),
    )


def merge_confidence(level: Column, validated: Column) -> Column:
    """Model level and validator confidence -> final band; the lower one counts."""
    score = F.when(level == "high", F.lit(1.0)).when(level == "medium", F.lit(0.5)).otherwise(F.lit(0.2))
    return text.confidence_band(F.least(score, validated))


# --- Citations --------------------------------------------------------------

_CITE = ["source_name", "indicator_code", "country_code", "period", "title"]


def unique_records(records: DataFrame, position: str) -> DataFrame:
    """First of each record id; rows without an id are told apart by what identifies them."""
    parts = ["type", *_CITE]
    ident = F.when(F.col("record_id").isNotNull(), F.struct(
        F.col("record_id").cast("string").alias("id"), *[F.lit(None).cast("string").alias(p) for p in parts]
    )).otherwise(F.struct(F.lit(None).cast("string").alias("id"), *[F.col(p).cast("string").alias(p) for p in parts]))
    return keyed.first_seen(records, [ident], [F.col(position)], records.columns)


def bibliography(records: DataFrame, position: str) -> DataFrame:
    """One citation per source, indicator, country, period and title; unattributed rows skipped."""
    named = records.filter(F.coalesce(F.col("source_name"), F.lit("")) != "")
    return keyed.first_seen(named, [F.col(c) for c in _CITE], [F.col(position)], records.columns)


# --- History ----------------------------------------------------------------

def last_messages(messages: DataFrame, n: int = 6) -> DataFrame:
    """Last n messages of every session."""
    return keyed.top_per_key(messages, ["session_id"], [F.col("turn").desc()], n, "_r").drop("_r")


def session_messages(messages: DataFrame, sessions: DataFrame, user: int, tenant: int | None) -> DataFrame:
    """Messages of the sessions that a user owns within a tenant."""
    mine = (F.col("user_id") == user) & F.col("tenant_id").eqNullSafe(F.lit(tenant))
    own = sessions.filter(mine).select(F.col("session_id").alias("_sid"))
    return messages.join(own, F.col("session_id") == F.col("_sid"), "left_semi")


def run_traces(steps: DataFrame, parts: int = 64) -> DataFrame:
    """Steps of a run as one ordered list per block of steps.

    A run's trace is nested in blocks of ``parts`` steps, so a run of any length
    is spread over many rows instead of one growing list.
    """
    block = F.floor(F.col("step_index") / parts).alias("block")
    entry = F.struct("step_index", "step_type", "payload")
    return steps.groupBy("run_id", block).agg(F.array_sort(F.collect_list(entry)).alias("steps"))
