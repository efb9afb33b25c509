"""Scorecards, freshness SLA, alerts, coverage, bias, oversight, escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import scoring, text
from tidemark.functions.numeric import lookup, plain, rnd, seconds_between
from tidemark.operators import keyed
from tidemark.session import materialise
from tidemark.operators.published import visible_to


# --- Source scorecards ------------------------------------------------------

def week_start(ts: Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("WEEK", ts).cast("date")


def scorecards(activity: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per active source and week, from the first to the last week with any activity.

    A source counts as active unless ``sources`` says otherwise in is_active. A week without
    rows has success rate 0, no quality (80 in the score), no revisions, and the source's overall
    conflict rate. ``activity`` is read once: weekly figures come from (source, week) partial
    aggregates, all-time figures from re-aggregating those.
    """
    c = F.col
    non_routine = F.col("severity") != "ROUTINE"
    weekly = activity.groupBy("source_code", week_start(F.col("crawled_at")).alias("week_start")).agg(
        F.count(F.lit(1)).alias("n"), F.count("raw_value").alias("n_ok"),
        F.sum("dq_score").alias("dq_sum"), F.count("dq_score").alias("dq_n"),
        F.count_if("is_revision").alias("n_revised"), F.count_if(non_routine).alias("n_conflict"),
    )
    weekly = materialise(activity.sparkSession, weekly, "weekly-activity")
    total = weekly.groupBy(F.col("source_code").alias("_src")).agg(
        F.sum("n").alias("_n"), F.sum("n_conflict").alias("_conflict")
    )
    first, last = weekly.agg(F.min("week_start"), F.max("week_start")).head()
    active = sources.filter(F.coalesce(c("is_active"), F.lit(True))) if "is_active" in sources.columns else sources
    span = F.sequence(F.lit(first), F.lit(last), F.expr("INTERVAL 7 DAYS")) if first else F.array().cast("array<date>")
    grid = active.select("source_code", "has_error", F.explode(span).alias("week_start"))
    joined = grid.join(weekly, ["source_code", "week_start"], "left").join(total, c("source_code") == c("_src"), "left")
    measured = joined.select(
        "source_code", "week_start",
        F.coalesce(c("n_ok") / c("n") * 100, F.lit(0.0)).alias("extraction_success_rate"),
        F.try_divide(c("dq_sum"), c("dq_n")).alias("avg_quality_score"),
        F.coalesce(c("n_revised") / c("_n"), F.lit(0.0)).alias("revision_frequency"),
        F.coalesce(c("_conflict") / c("_n"), F.lit(0.0)).alias("conflict_rate"),
        F.when(c("has_error"), F.lit(90.0)).otherwise(F.lit(95.0)).alias("availability_uptime"),
    )
    score = (
        c("extraction_success_rate") / 100 * 0.3
        + F.coalesce(c("avg_quality_score"), F.lit(80.0)) / 100 * 0.3
        + (F.lit(1.0) - c("revision_frequency")) * 0.2
        + (F.lit(1.0) - c("conflict_rate")) * 0.1
        + c("availability_uptime") / 100 * 0.1
    ) * 100
    return measured.withColumn("source_reputation_score", score)


def latest_scorecards(cards: DataFrame) -> DataFrame:
    payload = [c for c in cards.columns if c != "source_code"]
    return keyed.latest(cards, ["source_code"], [F.col("week_start")], payload).orderBy(
        F.col("source_reputation_score").desc(), "source_code"
    )


# --- Freshness --------------------------------------------------------------

def sla_status(spark: SparkSession, gold: DataFrame, as_of: Column) -> DataFrame:
    """Age of the newest crawl per watched indicator against its tier's window."""
    watched = spark.createDataFrame(
        [(code, t, K.SLA_WINDOW_MINUTES[t]) for t, codes in K.SLA_TIERS.items() for code in codes],
        "indicator_code string, tier string, window_minutes int",
    )
    newest = gold.groupBy(F.col("indicator_code").alias("_code")).agg(
        F.max("crawled_at").alias("last_crawled_at"),
        F.max_by("country_code", F.struct("crawled_at", "record_id")).alias("country_code"),
    )
    age = seconds_between(as_of, F.col("last_crawled_at")) / 60
    return watched.join(newest, F.col("indicator_code") == F.col("_code"), "left").select(
        "indicator_code", "tier", "window_minutes", "last_crawled_at", "country_code",
        F.coalesce(age, F.lit(-1.0)).alias("age_minutes"),
        F.coalesce(age <= F.col("window_minutes"), F.lit(False)).alias("compliant"),
    )


def sla_rollup(status: DataFrame) -> DataFrame:
    """Compliant share per tier and overall (tier ALL)."""
    pct = F.count_if("compliant") / F.count(F.lit(1)) * 100
    return status.rollup("tier").agg(
        F.grouping("tier").alias("_all"), F.count(F.lit(1)).alias("n"), rnd(pct, 1).alias("compliance_pct")
    ).select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("tier")).alias("tier"), "n", "compliance_pct")


def tiered(rows: DataFrame) -> DataFrame:
    tier = scoring.sla_tier(F.col("indicator_code"))
    return rows.withColumn("tier", tier).withColumn("window_minutes", lookup(F.col("tier"), K.SLA_WINDOW_MINUTES))


# --- Alerts -----------------------------------------------------------------

def alerts(gold: DataFrame, as_of: Column, tenant: int | None, days: int = 1) -> DataFrame:
    """Threshold breaches among recently published actuals."""
    recent = visible_to(gold, tenant).filter(
        (F.col("promoted_at") >= F.timestamp_add("DAY", F.lit(-days), as_of)) & ~F.col("is_forecast")
    )
    hot = (F.col("indicator_code") == "CPI_INFLATION") & (F.col("value") > 5)
    shrinking = (F.col("indicator_code") == "GDP_GROWTH") & (F.col("value") < 0)
    message = F.when(
        hot, F.concat(F.lit("High Inflation Alert: "), F.col("country_code"), F.lit(" CPI is "), plain("value"), F.lit("%"))
    ).otherwise(
        F.concat(F.lit("Negative Growth: "), F.col("country_code"), F.lit(" GDP growth is "), plain("value"), F.lit("%"))
    )
    return recent.filter(hot | shrinking).select(
        "record_id", "indicator_code", "country_code", F.when(hot, "CRITICAL").otherwise("WARNING").alias("type"),
        message.alias("message"), F.col("promoted_at").alias("logged_at"), "tenant_id",
    )


def recent_alerts(log: DataFrame, tenant: int | None, limit: int = 20) -> DataFrame:
    return visible_to(log, tenant).orderBy(F.col("logged_at").desc(), "record_id").limit(limit)


def audit_window(log: DataFrame, as_of: Column, days: int, table_name: str | None = None, limit: int = 100) -> DataFrame:
    out = log.filter(F.col("logged_at") >= F.timestamp_add("DAY", F.lit(-days), as_of))
    if table_name:
        out = out.filter(F.col("table_name") == table_name)
    return out.orderBy(F.col("logged_at").desc(), F.col("log_id")).limit(limit)


# --- Coverage ---------------------------------------------------------------

def coverage(gold: DataFrame, countries: DataFrame) -> DataFrame:
    """Distinct indicators per country against the catalogue; tracked countries without data show 0."""
    seen = gold.groupBy("country_code").agg(
        F.countDistinct("indicator_code").alias("_n"), F.max("crawled_at").alias("last_updated")
    )
    tracked = countries.select(F.col("country_code").alias("_cc"), "country_name")
    joined = seen.join(tracked, F.col("country_code") == F.col("_cc"), "full_outer").select(
        F.coalesce("country_code", "_cc").alias("country_code"),
        F.coalesce("country_name", "country_code", "_cc").alias("country_name"),
        F.coalesce(F.col("_n"), F.lit(0)).alias("indicators_covered"), "last_updated",
    )
    score = F.col("indicators_covered") / K.TOTAL_INDICATORS * 100
    return joined.withColumn("coverage_score", score).withColumn(
        "notice", text.coverage_notice(F.col("country_name"), F.col("coverage_score"))
    )


# --- Personalisation bias ---------------------------------------------------

def bias_alerts(sessions: DataFrame, messages: DataFrame, record_regions: DataFrame, all_regions: list[str],
                last_sessions: int = 30) -> DataFrame:
    """Users whose last sessions only touched records of one region, all users in one plan.

    ``record_regions``: record_id, region. Regions are a small fixed set, so the
    per-user set stays tiny however many messages a user has.
    """
    recent = keyed.top_per_key(
        sessions, ["user_id"], [F.col("last_active").desc(), F.col("session_id").desc()], last_sessions
    ).select(F.col("session_id").alias("_sid"), F.col("user_id").alias("_uid"))
    per_user = recent.groupBy(F.col("_uid").alias("user_id")).agg(F.count(F.lit(1)).alias("session_count"))
    used = messages.filter(F.col("record_ids").isNotNull()).select(
        "session_id", F.explode("record_ids").alias("_rid")
    ).join(recent, F.col("session_id") == F.col("_sid"))
    regions = used.join(record_regions, F.col("_rid") == F.col("record_id")).groupBy(F.col("_uid")).agg(
        F.collect_set("region").alias("_regions")
    )
    one = regions.filter(F.size("_regions") == 1).withColumn("dominant_region", F.col("_regions")[0])
    universe = F.array(*[F.lit(r) for r in sorted(all_regions)])
    missing = F.array_except(universe, F.col("_regions"))
    return one.join(per_user, F.col("_uid") == F.col("user_id")).select(
        F.sha2(F.col("user_id").cast("string"), 256).alias("user_id_hash"), "user_id", "session_count",
        "dominant_region", F.array_join(missing, ",").alias("other_regions_missing"),
        text.diversity_nudge(F.col("dominant_region"), missing).alias("nudge"),
    )


# --- Oversight and accountability -------------------------------------------

def oversight_pending(approvals: DataFrame) -> DataFrame:
    """Latest pending approval per record with no approval or rejection after it.

    One aggregate per record instead of a theta join: the latest pending row and
    the time of the latest final decision.
    """
    pending = F.col("decision") == "PENDING_REVIEW"
    final = F.col("decision").isin("APPROVED", "REJECTED")
    state = approvals.groupBy("silver_id").agg(
        F.max_by(F.struct("approval_id", "dq_score", "decided_at"),
                 F.when(pending, F.struct("decided_at", "approval_id"))).alias("_p"),
        F.max(F.when(final, F.col("decided_at"))).alias("_closed"),
    )
    still_open = F.col("_p").isNotNull() & (F.col("_closed").isNull() | (F.col("_closed") <= F.col("_p.decided_at")))
    return state.filter(still_open).select(
        "silver_id", F.col("_p.approval_id").alias("approval_id"), F.col("_p.dq_score").alias("dq_score"),
        F.col("_p.decided_at").alias("decided_at"),
    )


def escalate(tasks: DataFrame, as_of: Column) -> DataFrame:
    """Overdue pending tasks move one level up with that level's deadline; the top level stays."""
    breached = (F.col("status") == "PENDING") & (F.col("sla_deadline") < as_of)
    moved = breached & (F.col("level") < 5)
    hours = lookup(F.col("level") + 1, {k: v or 4 for k, v in K.LEVEL_SLA_HOURS.items()})
    keep = [c for c in tasks.columns if c not in ("level", "sla_deadline")]
    return tasks.select(
        *keep, F.when(moved, F.col("level") + 1).otherwise(F.col("level")).alias("level"),
        F.when(moved, F.timestamp_add("HOUR", hours, as_of)).otherwise(F.col("sla_deadline")).alias("sla_deadline"),
        F.when(moved, F.col("level")).alias("escalated_from"),
        (breached & ~moved).alias("stuck_at_top"),
    )


def open_tasks(tasks: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    left = F.greatest(F.lit(0.0), seconds_between(F.col("sla_deadline"), as_of) / 3600)
    out = tasks.filter(F.col("status") == "PENDING").select(
        "task_id", "level", lookup(F.col("level"), K.LEVEL_NAMES).alias("level_name"), "sla_deadline",
        left.alias("remaining_hours"), (F.col("sla_deadline") < as_of).alias("sla_breached"),
    ).orderBy("sla_deadline", "task_id")
    return out if limit is None else out.limit(limit)


def decision_distribution(decisions: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Share and confidence range per decision inside the window."""
    recent = decisions.filter(F.col("decided_at") >= F.timestamp_add("DAY", F.lit(-days), as_of))
    counted = recent.groupBy("decision").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence"),
        F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"),
    )
    # At most three decisions: the un-partitioned window sees three rows.
    from pyspark.sql import Window

    share = F.col("n") / F.sum("n").over(Window.partitionBy()) * 100
    return counted.select(
        "decision", "n", rnd(share, 1).alias("pct"), rnd("avg_confidence", 4).alias("avg_confidence"),
        rnd("min_confidence", 4).alias("min_confidence"), rnd("max_confidence", 4).alias("max_confidence"),
    )
