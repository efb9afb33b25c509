"""Multi-source conflicts, revisions, value time travel and the four-layer validator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.numeric import (
    fixed, lookup, pct_change, plain, rnd, seconds_between, whole_days,
)
from tidemark.operators import keyed

KEY = ["indicator_code", "country_code", "period"]


def conflict_spread(candidates: DataFrame) -> DataFrame:
    """(max - min) / |mean| in percent per key, 0 when the mean is 0."""
    mean = F.avg("value")
    spread = F.when(mean != 0, (F.max("value") - F.min("value")) / F.abs(mean) * 100).otherwise(F.lit(0.0))
    return candidates.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_candidates"), rnd(spread, 6).alias("variance_pct"))


def resolve_conflicts(candidates: DataFrame, gold: DataFrame, as_of: Column) -> DataFrame:
    """One decision per key, from candidates (one row per source).

    Below 1 % spread the most reliable source wins, up to 5 % reliability is
    blended with recency, above that the newest published value of the
    (indicator, country) is kept and the key goes to review.
    """
    hours = seconds_between(as_of, F.col("crawled_at")) / 3600
    recency = rnd(F.col("reliability") * 0.7 + F.lit(30.0) / (hours + 1), 9)
    pick = F.struct("source_code", "value")
    mean = F.avg("value")
    spread = F.when(mean != 0, (F.max("value") - F.min("value")) / F.abs(mean) * 100).otherwise(F.lit(0.0))
    per_key = candidates.withColumn("_recency", recency).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        rnd(spread, 6).alias("variance_pct"),
        F.min_by(pick, F.struct(-F.col("reliability"), F.col("source_code"))).alias("_reliable"),
        F.min_by(pick, F.struct(-F.col("_recency"), F.col("source_code"))).alias("_blended"),
    )
    newest = keyed.latest(
        gold.withColumnsRenamed({"indicator_code": "_gi", "country_code": "_gc"}), ["_gi", "_gc"],
        [F.col("period"), F.col("promoted_at"), F.col("record_id")], ["source_code", "value"],
    ).select("_gi", "_gc", F.struct("source_code", "value").alias("_kept"))
    joined = per_key.join(
        newest, (F.col("indicator_code") == F.col("_gi")) & (F.col("country_code") == F.col("_gc")), "left"
    )
    v = F.col("variance_pct")
    single = F.col("n_candidates") <= 1
    severity = (
        F.when(single | (v < 1), "ROUTINE").when(v <= 5, "MODERATE").otherwise("MAJOR")
    )
    chosen = (
        F.when(F.col("severity") == "ROUTINE", F.col("_reliable"))
        .when(F.col("severity") == "MODERATE", F.col("_blended"))
        .otherwise(F.coalesce(F.col("_kept"), F.col("_reliable")))
    )
    return (
        joined.withColumn("variance_pct", F.when(single, F.lit(0.0)).otherwise(v))
        .withColumn("severity", severity)
        .withColumn("_chosen", chosen)
        .select(
            *KEY, "n_candidates", "variance_pct", "severity",
            F.col("_chosen.source_code").alias("selected_source"),
            F.col("_chosen.value").alias("selected_value"),
            (F.col("severity") == "MAJOR").alias("requires_review"),
            rationale(F.col("severity"), v, F.col("n_candidates"), F.col("_chosen.source_code"),
                      F.col("_kept").isNotNull()).alias("rationale"),
        )
    )


def rationale(severity: Column, spread: Column, n: Column, source: Column, kept: Column) -> Column:
    pct = F.concat(F.lit("Variance "), fixed(spread, 3), F.lit("%"))
    return (
        F.when(n <= 1, F.lit("Single source, no conflict."))
        .when(severity == "ROUTINE", F.concat(pct, F.lit(" below 1%: most reliable source "), source, F.lit(".")))
        .when(severity == "MODERATE", F.concat(
            pct, F.lit(" within 1-5%: best blend of reliability and recency "), source, F.lit(".")))
        .when(kept, F.concat(pct, F.lit(" above 5%: published value of "), source, F.lit(" retained.")))
        .otherwise(F.concat(pct, F.lit(" above 5%, nothing published: most reliable source "), source, F.lit(".")))
    )


def recent_conflicts(log: DataFrame, as_of: Column, days: int = 7, indicator: str | None = None,
                     limit: int = 200) -> DataFrame:
    out = log.filter(F.col("resolved_at") >= F.timestamp_add("DAY", F.lit(-days), as_of))
    if indicator:
        out = out.filter(F.col("indicator_code") == indicator)
    return out.orderBy(F.col("resolved_at").desc(), *KEY).limit(limit)


def selection_log(candidates: DataFrame, resolved: DataFrame, as_of: Column) -> DataFrame:
    """Per decision the competing candidates, one entry per source (bounded by the number of sources)."""
    entry = F.struct(
        "source_code", "reliability", "value",
        (F.floor(seconds_between(as_of, F.col("crawled_at")) / 3600)).alias("freshness_hours"),
        F.col("dq_score").alias("quality"),
    )
    lists = candidates.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(entry)).alias("candidates"), F.max("crawled_at").alias("decided_at")
    )
    return lists.join(resolved.select(*KEY, "selected_source", "rationale"), KEY)


def selection_history(log: DataFrame, indicator: str, limit: int = 50) -> DataFrame:
    return log.filter(F.col("indicator_code") == indicator).orderBy(F.col("decided_at").desc(), *KEY).limit(limit)


# --- Revisions --------------------------------------------------------------

def current_values(gold: DataFrame) -> DataFrame:
    """Newest published row per key."""
    return keyed.latest(gold, KEY, [F.col("promoted_at"), F.col("record_id")], ["record_id", "value"])


def detect_revisions(gold: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming values that differ from the current published value of their key."""
    now = current_values(gold).select(
        *[F.col(k).alias(f"_{k}") for k in KEY], F.col("record_id").alias("gold_record_id"),
        F.col("value").alias("old_value"),
    )
    cond = F.lit(True)
    for k in KEY:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    changed = incoming.join(now, cond).filter(
        F.col("old_value").isNotNull() & (F.col("value") != F.col("old_value"))
    )
    revision = pct_change("value", "old_value")
    return changed.select(
        *KEY, "source_code", "gold_record_id", "old_value", F.col("value").alias("new_value"),
        revision.alias("revision_pct"), (F.abs(rnd(revision, 6)) > 10).alias("is_significant"), "revised_at",
    )


def revision_chain(gold: DataFrame) -> DataFrame:
    """Revision log implied by successive promotions of a key with a different value."""
    chained = keyed.carry_forward(
        gold, KEY, "promoted_at", "record_id", F.struct(F.col("value").alias("value")), "_old"
    )
    return chained.filter(F.col("_old").isNotNull() & (F.col("_old.value") != F.col("value"))).select(
        *KEY, "source_code", "record_id", F.col("_old.value").alias("old_value"), F.col("value").alias("new_value"),
        pct_change(F.col("value"), F.col("_old.value")).alias("revision_pct"),
        F.col("promoted_at").alias("revised_at"),
    )


def revision_history(log: DataFrame, indicator: str, country: str | None = None, limit: int = 100) -> DataFrame:
    out = log.filter(F.col("indicator_code") == indicator)
    if country:
        out = out.filter(F.col("country_code") == country)
    return out.orderBy(F.col("revised_at").desc(), F.col("record_id")).limit(limit)


def value_as_of(gold: DataFrame, log: DataFrame, as_of: Column) -> DataFrame:
    """Value of every key as it was known at ``as_of``.

    The current value unless a revision came later; then the old value of the
    earliest such revision.
    """
    first_later = log.filter(F.col("revised_at") > as_of).groupBy(*KEY).agg(
        F.min_by("old_value", F.struct("revised_at", "record_id")).alias("_old")
    )
    return current_values(gold).join(first_later, KEY, "left").select(
        *KEY, F.coalesce(F.col("_old"), F.col("value")).alias("value"), F.col("_old").isNotNull().alias("was_revised"),
    )


def values_as_of(requests: DataFrame, gold: DataFrame, log: DataFrame) -> DataFrame:
    """Value of each request's key as it was known at the request's own ``as_of``.

    ``requests``: request_id, the key, as_of. Revisions and requests of a key are put in one
    order of time; each request takes the old value of the first revision after it, and the
    current value if there is none.
    """
    marks = log.select(*KEY, F.col("revised_at").alias("at"), F.col("record_id").alias("tie"), F.struct("old_value").alias("old"), F.lit(None).cast("bigint").alias("request_id"))
    asked = requests.select(*KEY, F.col("as_of").alias("at"), F.lit(2**62).alias("tie"), F.lit(None).cast("struct<old_value:double>").alias("old"), "request_id")
    found = keyed.carry(marks.unionByName(asked), KEY, "at", "tie", F.col("old"), "_next", forward=False).filter(F.col("request_id").isNotNull())
    return found.join(current_values(gold).select(*KEY, "value"), KEY, "left").select(
        "request_id", *KEY, F.col("at").alias("as_of"), F.coalesce(F.col("_next.old_value"), F.col("value")).alias("value"),
        F.col("_next").isNotNull().alias("was_revised"),
    )


# --- Validator --------------------------------------------------------------

def previous_period_value(gold: DataFrame) -> DataFrame:
    """Newest and second-newest period per (indicator, country) with a value of each.

    Enough to answer, for any row, the newest value of *another* period.
    """
    g = keyed.latest(gold, KEY, [F.col("promoted_at"), F.col("record_id")], ["value"])
    top = keyed.top_per_key(g, ["indicator_code", "country_code"], [F.col("period").desc()], 2)
    first = F.max(F.when(F.col("rank") == 1, F.struct("period", "value")))
    second = F.max(F.when(F.col("rank") == 2, F.struct("period", "value")))
    return top.groupBy("indicator_code", "country_code").agg(first.alias("_p1"), second.alias("_p2"))


def validate(rows: DataFrame, gold: DataFrame, as_of: Column) -> DataFrame:
    """Schema, range, consistency and freshness failures with the resulting score."""
    c = F.col
    latest = previous_period_value(gold).withColumnsRenamed({"indicator_code": "_pi", "country_code": "_pc"})
    joined = rows.join(
        latest, (c("indicator_code") == c("_pi")) & (c("country_code") == c("_pc")), "left"
    ).withColumns({
        "_prev": F.when(c("_p1.period") != c("period"), c("_p1.value")).otherwise(c("_p2.value")),
        "_lo": lookup(c("indicator_code"), {k: v[0] for k, v in K.VALIDATOR_RANGES.items()}),
        "_hi": lookup(c("indicator_code"), {k: v[1] for k, v in K.VALIDATOR_RANGES.items()}),
        "_max": lookup(c("indicator_code"), K.VALIDATOR_MAX_CHANGE_PCT),
        "_days": F.coalesce(lookup(c("indicator_code"), K.VALIDATOR_REFRESH_DAYS), F.lit(K.VALIDATOR_DEFAULT_DAYS)),
        "_age": whole_days(as_of, c("crawled_at")),
    })
    change = F.when(c("_prev") != 0, rnd(F.abs((c("value") - c("_prev")) / F.abs(c("_prev"))) * 100, 6))

    def failure(layer: str, field: str, severity: str, message: Column) -> Column:
        return F.struct(
            F.lit(layer).alias("layer"), F.lit(field).alias("field"),
            F.lit(severity).alias("severity"), message.alias("message"),
        )

    required = ["indicator_code", "country_code", "period", "value", "standard_unit"]
    checks = [
        F.when(c(f).isNull(), failure("SCHEMA", f, "ERROR", F.lit(f"Field '{f}' must not be null.")))
        for f in required
    ]
    checks += [
        F.when(F.length("country_code") != 3, failure(
            "SCHEMA", "country_code", "ERROR",
            F.concat(F.lit("country_code must be exactly 3 characters, got '"), c("country_code"), F.lit("'.")))),
        F.when((c("value") < c("_lo")) | (c("value") > c("_hi")), failure(
            "RANGE", "value", "ERROR",
            F.concat(c("indicator_code"), F.lit(" value "), plain("value"), F.lit(" is outside ["),
                     plain("_lo"), F.lit(", "), plain("_hi"), F.lit("].")))),
        F.when(c("_change") > c("_max"), failure(
            "CONSISTENCY", "value", "ERROR",
            F.concat(c("indicator_code"), F.lit(" changed by "), fixed("_change", 1), F.lit("% from "), plain("_prev")))),
        F.when(c("value").isNotNull() & (c("_age") > c("_days") * 2), failure(
            "FRESHNESS", "crawled_at", "WARNING",
            F.concat(F.lit("Data is "), c("_age").cast("string"), F.lit(" days old, expected every "),
                     c("_days").cast("string"), F.lit(" days.")))),
    ]
    failed = joined.withColumn("_change", change).select(
        *rows.columns, F.array_compact(F.array(*checks)).alias("failures")
    )
    errors = F.size(F.filter("failures", lambda f: f["severity"] == "ERROR"))
    warnings = F.size("failures") - errors
    return failed.withColumns({"n_errors": errors, "n_warnings": warnings}).withColumn(
        "score", F.greatest(F.lit(0.0), F.lit(100.0) - c("n_errors") * 20.0 - c("n_warnings") * 5.0)
    ).withColumn("passed", (c("score") >= 70) & (c("n_errors") == 0))
