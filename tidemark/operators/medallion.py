"""Bronze -> Silver -> Gold: parse, score, route, promote, queue, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import parsing, scoring
from tidemark.functions.numeric import plain, text_array, whole_days
from tidemark.operators import keyed
from tidemark.operators.shape import computed_once


def stable_id(*parts: Column) -> Column:
    """Deterministic identifier of a natural key."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def to_silver(bronze: DataFrame, as_of: Column) -> DataFrame:
    """Parsed value, sub-scores, reasons and routing status of every Bronze row: one projection."""
    c = F.col
    parsed = parsing.with_value(bronze).withColumns({
        "_low": scoring.bound(c("indicator_code"), c("standard_unit"), 0),
        "_high": scoring.bound(c("indicator_code"), c("standard_unit"), 1),
        "_year": scoring.period_year(c("period")),
        "_age": F.coalesce(whole_days(as_of, c("crawled_at")), F.lit(0)),
    })
    acc, acc_why = scoring.accuracy(c("value"), c("_low"), c("_high"))
    comp, comp_why = scoring.completeness(
        {n: c(n) for n in ("indicator_code", "country_code", "period", "raw_value")}
    )
    time, time_why = scoring.timeliness(c("_year"), F.year(as_of) - c("_year"), c("_age"))
    cons, cons_why = scoring.consistency(c("standard_unit"), c("raw_unit"))
    scored = parsed.withColumns({
        "accuracy": acc, "completeness": comp, "timeliness": time, "consistency": cons,
    }).withColumn(
        "dq_score",
        scoring.weighted_total(c("accuracy"), c("completeness"), c("timeliness"), c("consistency")),
    ).withColumn("dq_status", scoring.dq_status(c("dq_score")))
    pinned = computed_once(scored, [x for x in scored.columns if x not in bronze.columns])
    # Wording and flags sit on top, so that jobs which do not read them do not compute them.
    return pinned.select(
        *bronze.columns, "value", parsing.is_forecast("raw_value").alias("is_forecast"),
        "accuracy", "completeness", "timeliness", "consistency",
        text_array([*acc_why, *comp_why, *time_why, *cons_why]).alias("failure_reasons"),
        parsing.conversion_note(c("value"), c("raw_unit"), c("standard_unit")).alias("normalisation"),
        "dq_score", "dq_status",
    )


def silver_id(bronze_id: Column) -> Column:
    return stable_id(F.lit("silver"), bronze_id)


def status_counts(silver: DataFrame) -> DataFrame:
    """Rows and mean quality per source and routing status."""
    return silver.groupBy("source_code", "dq_status").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum((F.col("dq_score") * 100).cast("bigint")) / F.count(F.lit(1)) / 100).alias("avg_dq"),
    )


def outcome_counts(silver: DataFrame) -> DataFrame:
    """Ingest outcome of a run in one pass."""
    status = F.col("dq_status")
    return silver.agg(
        F.count_if(status == "AUTO_PROMOTED").alias("promoted"),
        F.count_if(status == "REVIEW").alias("queued"),
        F.count_if(status == "REJECTED").alias("rejected"),
    )


def unprocessed(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """Bronze rows that have no Silver row yet."""
    return bronze.join(silver.select("bronze_id"), F.col("record_id") == F.col("bronze_id"), "left_anti")


def promotion_backlog(silver: DataFrame, gold: DataFrame) -> DataFrame:
    """Auto-promoted Silver rows not published yet."""
    ready = silver.filter(F.col("dq_status") == "AUTO_PROMOTED")
    return ready.join(gold.select(F.col("silver_id").alias("_sid")), F.col("silver_id") == F.col("_sid"), "left_anti")


def with_sources(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Source name and url; unknown sources keep their code and an empty url."""
    dim = sources.select(
        F.col("source_code").alias("_code"), F.col("source_name").alias("_name"), F.col("source_url").alias("_url")
    )
    return df.join(F.broadcast(dim), F.col("source_code") == F.col("_code"), "left").select(
        *df.columns,
        F.coalesce(F.col("_name"), F.col("source_code")).alias("source_name"),
        F.coalesce(F.col("_url"), F.lit("")).alias("registered_url"),
    )


def flag_revisions(promotions: DataFrame, bucket: str = "HOUR") -> DataFrame:
    """Revision flag and delta against the last actual published earlier for the same key.

    ``promotions`` holds everything published so far plus the new rows, with
    (promoted_at, record_id) giving the order. A row sees earlier rows of its own tenant and
    global ones (no tenant); a global row sees global ones only. Publishing the same value
    again still counts as a revision, with delta 0. Rows without that column are all global.
    """
    keys = ["indicator_code", "country_code", "period"]
    previous = F.when(~F.col("is_forecast"), F.struct("promoted_at", "record_id", F.col("value").alias("value")))
    rows = promotions if "tenant_id" in promotions.columns else promotions.withColumn("tenant_id", F.lit(None).cast("bigint"))
    # Nearest earlier row of the own tenant, and nearest earlier global row: the later of the two counts.
    values = {"_tenants": (previous, ["tenant_id"]), "_global": (F.when(F.col("tenant_id").isNull(), previous), [])}
    both = keyed.carry_several(rows, keys, "promoted_at", "record_id", values, bucket)
    seen = F.greatest("_tenants", "_global")
    return both.withColumn("_prev", seen).select(
        *promotions.columns,
        F.col("_prev").isNotNull().alias("revision_flag"),
        (F.col("value") - F.col("_prev.value")).alias("revision_delta"),
    )


def review_items(silver: DataFrame, as_of: Column) -> DataFrame:
    """Queue rows for the review band, due after the review SLA."""
    return silver.filter(F.col("dq_status") == "REVIEW").select(
        stable_id(F.lit("queue"), F.col("record_id")).alias("queue_id"),
        F.col("record_id").alias("bronze_id"), "tenant_id", "indicator_code", "country_code", "period",
        F.coalesce(plain("value"), F.lit("N/A")).alias("extracted_value"),
        "value", "standard_unit", "is_forecast", "source_code", "source_url", "dq_score", "failure_reasons",
        F.lit("PENDING").alias("status"),
        as_of.alias("created_at"),
        F.timestamp_add("HOUR", F.lit(K.REVIEW_SLA_HOURS), as_of).alias("sla_deadline"),
    )


def apply_decisions(queue: DataFrame, decisions: DataFrame, key: str = "queue_id") -> DataFrame:
    """Analyst decisions on pending items: ADJUSTED (new value), APPROVED or REJECTED.

    ``decisions``: the queue's ``key``, action (approve / reject), adjusted_value, reviewer. Items
    not pending, or without a decision, are unchanged.
    """
    d = decisions.select(
        F.col(key).alias("_qid"), "action", "adjusted_value", F.col("reviewer").alias("reviewed_by")
    )
    open_item = (F.col("status") == "PENDING") & F.col("_qid").isNotNull()
    approve = open_item & (F.col("action") == "approve")
    status = (
        F.when(approve & F.col("adjusted_value").isNotNull(), "ADJUSTED")
        .when(approve, "APPROVED")
        .when(open_item & (F.col("action") == "reject"), "REJECTED")
        .otherwise(F.col("status"))
    )
    final = F.when(approve, F.coalesce(F.col("adjusted_value"), F.col("value"))).otherwise(F.col("value"))
    keep = [c for c in queue.columns if c not in ("status", "value")]
    return queue.join(d, F.col(key) == F.col("_qid"), "left").select(
        *keep, status.alias("status"), final.alias("value"),
        F.when(open_item, F.col("reviewed_by")).alias("reviewed_by"),
    )


def approved_for_gold(queue: DataFrame) -> DataFrame:
    return queue.filter(F.col("status").isin("APPROVED", "ADJUSTED"))


def promoted_and_approved(silver: DataFrame, reviewed: DataFrame) -> DataFrame:
    """What reaches Gold: rows promoted on their own and rows that an analyst approved or adjusted.

    ``silver`` carries promoted_at; ``reviewed`` is the queue after ``apply_decisions``, with the
    time of the decision in decided_at.
    """
    keys = ["tenant_id", "indicator_code", "country_code", "period", "source_code", "value", "is_forecast"]
    auto = silver.filter(F.col("dq_status") == "AUTO_PROMOTED").select("record_id", *keys, "promoted_at", F.lit("auto").alias("approved_by"))
    approved = approved_for_gold(reviewed).select(
        F.col("bronze_id").alias("record_id"), *keys, F.col("decided_at").alias("promoted_at"), F.col("reviewed_by").alias("approved_by")
    )
    return auto.unionByName(approved)


def review_stats(queue: DataFrame, as_of: Column) -> DataFrame:
    status = F.col("status")
    return queue.agg(
        F.count_if(status == "PENDING").alias("pending"),
        F.count_if(status.isin("APPROVED", "ADJUSTED")).alias("approved"),
        F.count_if(status == "REJECTED").alias("rejected"),
        F.count_if((status == "PENDING") & (F.col("sla_deadline") < as_of)).alias("sla_breached"),
    )


def review_page(queue: DataFrame, as_of: Column, status: str = "PENDING", tenant=None, limit: int = 50) -> DataFrame:
    """Oldest deadlines first for one tenant (strict)."""
    page = queue.filter((F.col("status") == status) & F.col("tenant_id").eqNullSafe(F.lit(tenant)))
    return page.withColumn("sla_breached", F.col("sla_deadline") < as_of).orderBy(
        "sla_deadline", "bronze_id"
    ).limit(limit)


def repair_units(gold: DataFrame) -> DataFrame:
    """Bring bare absolute USD / head counts down to the standard unit; ``fixed`` marks the change."""
    repaired = parsing.repair_scale(F.col("value"), F.col("standard_unit"), magnitude=False)
    scale_hit = F.lit(False)
    for unit, threshold in K.UNIT_SCALE_RULES:
        scale_hit = scale_hit | ((F.col("standard_unit") == unit) & (F.col("value") >= threshold))
    keep = [c for c in gold.columns if c != "value"]
    return gold.select(*keep, repaired.alias("value"), F.coalesce(scale_hit, F.lit(False)).alias("fixed"))
