"""Lineage, trust explanations, quality breakdowns, citation trails and trace logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import text
from tidemark.functions.numeric import fixed, rnd
from tidemark.operators import keyed
from tidemark.sources import generations

_DIMS = list(K.DQ_WEIGHTS)


# --- Quality breakdown ------------------------------------------------------

def quality_breakdown(silver: DataFrame) -> DataFrame:
    """Weighted contribution of each sub-score for the latest Silver row of every key.

    Rows without the four sub-scores fall back to the overall score in each place.
    """
    payload = ["record_id", "dq_score", *_DIMS]
    newest = keyed.latest(
        silver, ["indicator_code", "country_code", "period"], [F.col("processed_at"), F.col("record_id")], payload
    )
    complete = F.lit(True)
    for d in _DIMS:
        complete = complete & F.col(d).isNotNull()
    base = F.coalesce(F.col("dq_score"), F.lit(0.0))
    raw = {d: F.when(complete, F.col(d)).otherwise(base) for d in _DIMS}
    overall = F.lit(0.0)
    for d in _DIMS:
        overall = overall + raw[d] * K.DQ_WEIGHTS[d]
    return newest.select(
        "indicator_code", "country_code", "period", "record_id",
        *[raw[d].alias(d) for d in _DIMS],
        *[rnd(raw[d] * K.DQ_WEIGHTS[d], 4).alias(f"{d}_weighted") for d in _DIMS],
        rnd(overall, 2).alias("overall_score"),
    )


# --- Trust ------------------------------------------------------------------

def trust_tier(score: Column) -> Column:
    return (
        F.when(score.isNull(), "unknown").when(score >= K.DQ_PROMOTE, "high")
        .when(score >= K.DQ_REVIEW, "medium").otherwise("low")
    )


def promotion_path(dq_status: Column, approved_by: Column, review_status: Column) -> Column:
    return (
        F.when(review_status.isin("APPROVED", "ADJUSTED"), F.concat(F.lit("HUMAN_REVIEW_"), review_status))
        .when(dq_status.isNotNull(), dq_status)
        .when(approved_by.isNotNull() & (approved_by != "auto"), "HUMAN_APPROVED")
        .otherwise("AUTO_PROMOTED")
    )


def _issues(dimension: str) -> Column:
    own = F.filter("_reasons", lambda r: text.reason_dimension(r) == dimension)
    return F.transform(own, text.reason_sentence)


def with_trust(rows: DataFrame) -> DataFrame:
    """Adds tier, promotion path, reasons to trust, caveats, per-dimension detail and a summary.

    Expects dq_score, the four sub-scores, failure_reasons, dq_status, approved_by,
    review_status, reviewed_by, review_notes, source_name, extraction_method.
    """
    c = F.col
    has = c("dq_score").isNotNull()
    score = {d: F.coalesce(c(d), F.when(has, F.lit(0.0))) for d in _DIMS}
    reasons = F.coalesce(c("failure_reasons"), F.array().cast("array<string>"))
    staged = rows.withColumns({
        "trust_tier": trust_tier(c("dq_score")),
        "promotion_path": promotion_path(c("dq_status"), c("approved_by"), c("review_status")),
        **{f"_s_{d}": score[d] for d in _DIMS},
        "_reasons": reasons,
    })
    tier, path = c("trust_tier"), c("promotion_path")
    human_review = path.startswith("HUMAN_REVIEW")
    reviewer = F.when(
        F.coalesce(c("reviewed_by"), F.lit("")) != "", F.concat(F.lit(" — "), c("reviewed_by"))
    ).otherwise(F.lit(""))
    pct = {d: fixed(c(f"_s_{d}"), 0) for d in _DIMS}
    why = F.array_compact(F.array(
        F.when(has, F.concat(F.lit("Composite DQ score is "), fixed("dq_score", 1), F.lit("% " + K.TRUST_MODEL))),
        F.when(tier == "high", F.lit(K.TRUST_HIGH)),
        F.when(human_review, F.concat(
            F.lit("An analyst reviewed this record ("), c("review_status"), F.lit(")"), reviewer, F.lit(" before it reached Gold.")))
        .when(c("approved_by") != "auto", F.concat(F.lit("Approved for Gold by "), c("approved_by"), F.lit("."))),
        F.when(F.coalesce(c("source_name"), F.lit("")) != "", F.concat(F.lit("Sourced from "), c("source_name"), F.lit("."))),
        F.when(F.coalesce(c("extraction_method"), F.lit("")) != "", F.concat(
            F.lit("Ingested via "), F.lower(F.replace(c("extraction_method"), F.lit("_"), F.lit(" "))), F.lit("."))),
        *[F.when(c(f"_s_{d}") >= 90, F.concat(
            F.lit(f"{K.DIMENSION_LABELS[d]} scored "), pct[d], F.lit("% — no material issues."))) for d in _DIMS],
    ))
    caveats = F.concat(
        F.array_compact(F.array(
            F.when(tier == "medium", F.lit(K.TRUST_MEDIUM)).when(tier == "low", F.lit(K.TRUST_LOW)),
            *[F.when(c(f"_s_{d}") < 70, F.concat(
                F.lit(f"{K.DIMENSION_LABELS[d]} scored only "), pct[d], F.lit("%."))) for d in _DIMS],
        )),
        F.transform("_reasons", text.reason_sentence),
        F.array_compact(F.array(F.when(
            F.coalesce(c("review_notes"), F.lit("")) != "", F.concat(F.lit("Reviewer notes: "), c("review_notes"))))),
    )
    label = F.lit(None).cast("string")
    for name, words in K.TRUST_LABELS.items():
        label = F.when(tier == name, F.lit(words)).otherwise(label)
    dimensions = F.array(*[
        F.struct(
            F.lit(d).alias("name"), F.lit(K.DIMENSION_LABELS[d]).alias("label"), c(f"_s_{d}").alias("score"),
            F.lit(w).alias("weight"), rnd(c(f"_s_{d}") * w, 2).alias("weighted_contribution"),
            _issues(d).alias("issues"),
        )
        for d, w in K.DQ_WEIGHTS.items()
    ])
    told = staged.withColumns({
        "trust_label": label, "why_trustable": why, "caveats": caveats, "dimensions": dimensions,
    })
    summary = F.concat_ws(
        " ",
        F.when(has, F.concat(F.lit("DQ "), fixed("dq_score", 1), F.lit("% ("), F.lower("trust_label"), F.lit(")."))),
        F.when(path.startswith("HUMAN"), F.lit("Human-reviewed before Gold.")).otherwise(F.lit("Automated pipeline promotion.")),
        F.when(F.size("caveats") == 0, F.lit("No outstanding quality flags.")),
    )
    drop = [f"_s_{d}" for d in _DIMS] + ["_reasons"]
    return told.withColumn("summary", summary).drop(*drop)


# --- Lineage ----------------------------------------------------------------

def lineage(gold: DataFrame, silver: DataFrame, reviews: DataFrame, edges: DataFrame) -> DataFrame:
    """Gold with its Silver, Bronze and review row, and the number of lineage entries touching it.

    ``silver`` carries its Bronze fields; ``reviews``: bronze_id, status, reviewed_by; ``edges``:
    edge_id, source_record_id, target_record_id. An entry may name the record on either side, so
    the either-side join is two equi-joins put together.
    """
    s = silver.select(
        F.col("record_id").alias("bronze_id"), F.col("dq_score").alias("silver_dq"), "dq_status", "failure_reasons",
        *_DIMS, F.col("source_url"), F.col("crawled_at").alias("bronze_crawled_at"),
        F.col("source_code").alias("bronze_source"),
    )
    r = reviews.select(
        F.col("bronze_id").alias("_rb"), F.col("status").alias("review_status"), "reviewed_by"
    )
    ends = edges.select(F.col("target_record_id").alias("_node"), "edge_id").unionByName(
        edges.filter(~F.col("source_record_id").eqNullSafe(F.col("target_record_id"))).select(
            F.col("source_record_id").alias("_node"), "edge_id"
        )
    ).groupBy("_node").agg(F.count(F.lit(1)).alias("n_lineage"))
    return (
        gold.join(s, F.col("silver_id") == F.col("bronze_id"), "left")
        .join(r, F.col("bronze_id") == F.col("_rb"), "left")
        .join(ends, F.col("record_id") == F.col("_node"), "left")
        .drop("_rb", "_node")
        .withColumn("n_lineage", F.coalesce(F.col("n_lineage"), F.lit(0)))
    )


# --- Citation trail ---------------------------------------------------------

def citation_trails(gold: DataFrame, accesses: DataFrame) -> DataFrame:
    """Three levels per key: published figure, its source, and how often it was looked up.

    ``accesses``: the key plus access_type (chatbot or anything else = api). Keys nobody
    looked up count zero; look-ups of unknown keys are ignored.
    """
    key = ["indicator_code", "country_code", "period"]
    newest = keyed.latest(gold, key, [F.col("promoted_at"), F.col("record_id")],
                          ["record_id", "value", "standard_unit", "source_code", "dq_score", "crawled_at"])
    counted = accesses.groupBy(*key).agg(
        F.count_if(F.col("access_type") == "chatbot").alias("_chat"),
        F.count_if(F.col("access_type") != "chatbot").alias("_api"),
    )
    zero = F.lit(0)
    return newest.join(counted, key, "left").select(
        F.md5(F.concat_ws("|", F.lit("trail"), *key)).alias("trail_id"), *key,
        F.struct("value", "standard_unit", "source_code").alias("level1"),
        F.struct("record_id", "dq_score", "crawled_at").alias("level2"),
        F.struct(F.coalesce("_chat", zero).alias("chatbot_sessions_count"), F.coalesce("_api", zero).alias("api_calls_count")).alias("level3"),
    )


TRAIL_KEY = ["indicator_code", "country_code", "period"]
TRAIL_BUCKETS = 64
_TRAIL_LEVELS = ["record_id", "value", "standard_unit", "source_code", "dq_score", "crawled_at", "promoted_at"]
_TRAIL_COLUMNS = (
    "indicator_code string, country_code string, period string, record_id bigint, value double, standard_unit string, source_code string, "
    "dq_score double, crawled_at timestamp_ntz, promoted_at timestamp_ntz, chatbot_sessions_count bigint, api_calls_count bigint"
)


def trail_store(spark: SparkSession, path: str, every: int = generations.EVERY) -> generations.Generations:
    """Stored trails, one row per key, in buckets by key."""
    return generations.Generations(spark, path, TRAIL_KEY, _TRAIL_COLUMNS, "bucket", "int", every)


def update_trails(store: generations.Generations, gold: DataFrame, accesses: DataFrame, run: int) -> None:
    """One run: levels 1 and 2 of the keys in ``gold`` replaced, look-ups since the last run added to level 3.

    Only what is new is read, and only the buckets it falls into. A figure published earlier
    than the stored one replaces nothing; a new key starts at zero; look-ups of unknown keys are
    ignored. Repeating a run changes nothing.
    """
    store.tidy(run)
    if store.settled(run):
        return
    newest = keyed.latest(gold, TRAIL_KEY, [F.col("promoted_at"), F.col("record_id")], _TRAIL_LEVELS)
    counted = accesses.groupBy(*TRAIL_KEY).agg(
        F.count_if(F.col("access_type") == "chatbot").alias("_chat"), F.count_if(F.col("access_type") != "chatbot").alias("_api")
    )
    touched = newest.withColumn("_new", F.lit(True)).join(counted, TRAIL_KEY, "full_outer").withColumn(
        "bucket", F.pmod(F.xxhash64(*TRAIL_KEY), F.lit(TRAIL_BUCKETS)).cast("int")
    )
    known = store.newest(run, touched)
    both = touched.alias("n").join(known.alias("k"), [*TRAIL_KEY, "bucket"], "left")
    at = {side: F.struct(F.col(f"{side}.promoted_at"), F.col(f"{side}.record_id")) for side in "nk"}
    replaced = F.col("_new").isNotNull() & (F.col("k.record_id").isNull() | (at["n"] >= at["k"]))
    zero = F.lit(0).cast("bigint")
    rows = both.where(F.col("_new").isNotNull() | F.col("k.record_id").isNotNull()).select(
        *TRAIL_KEY, *[F.when(replaced, F.col(f"n.{c}")).otherwise(F.col(f"k.{c}")).alias(c) for c in _TRAIL_LEVELS],
        *[(F.coalesce(F.col(new), zero) + F.coalesce(F.col(f"k.{old}"), zero)).alias(old)
          for new, old in (("_chat", "chatbot_sessions_count"), ("_api", "api_calls_count"))],
        "bucket",
    )
    store.add(rows, run)


def stored_trails(store: generations.Generations, before: int) -> DataFrame:
    """Three levels per key, as ``citation_trails`` gives them, from the store."""
    return store.newest(before).select(
        F.md5(F.concat_ws("|", F.lit("trail"), *TRAIL_KEY)).alias("trail_id"), *TRAIL_KEY,
        F.struct("value", "standard_unit", "source_code").alias("level1"),
        F.struct("record_id", "dq_score", "crawled_at").alias("level2"),
        F.struct("chatbot_sessions_count", "api_calls_count").alias("level3"),
    )


# --- Traces -----------------------------------------------------------------

def extraction_traces(rows: DataFrame) -> DataFrame:
    """Trace rows keep an excerpt of the source text of at most 500 characters.

    ``rows``: trace_id, source_url, raw_text, model, confidence.
    """
    return rows.select(
        "trace_id", "source_url", F.substring("raw_text", 1, 500).alias("raw_excerpt"),
        F.length("raw_text").alias("source_chars"), "model", "confidence",
    )
