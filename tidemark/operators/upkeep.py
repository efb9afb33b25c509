"""Crawling economy, costs, retention, consent, policies, limits and resource profile."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.numeric import lookup, rnd
from tidemark.operators import keyed


# --- Crawling ---------------------------------------------------------------

def since(df: DataFrame, column: str, as_of: Column, days: int) -> DataFrame:
    return df.filter(F.col(column) >= F.timestamp_add("DAY", F.lit(-days), as_of))


def crawl_efficiency(log: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Skips against scheduled crawls and what they saved; deferrals are not scheduled crawls."""
    kind = F.col("action")
    saved = K.CRAWL_SESSION_SECONDS * K.CRAWLER_RATE_PER_SECOND
    counted = since(log, "logged_at", as_of, days).agg(
        F.count_if(kind.isin("SKIP", "PROCEED")).alias("scheduled"), F.count_if(kind == "SKIP").alias("skipped"),
        F.countDistinct(F.when(kind == "DEFER", F.col("source_code"))).alias("sources_deferred"),
    )
    return counted.select(
        "scheduled", "skipped",
        F.coalesce(rnd(F.try_divide(F.col("skipped") * 100, F.col("scheduled")), 2), F.lit(0.0)).alias("skip_rate_pct"),
        rnd(F.col("skipped") * F.lit(saved), 6).alias("saved_usd"), "sources_deferred",
    )


def deferred_sources(log: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return since(log, "logged_at", as_of, days).filter(F.col("action") == "DEFER").select("source_code").distinct()


def crawl_budget(sources: DataFrame, cost_each: float, ceiling: float = K.CRAWL_COST_CEILING) -> DataFrame:
    """Best-reputed sources first until the money is spent, the rest deferred.

    The running cost of a source is its place in the order times the cost, and places come from
    a distributed prefix sum, so nothing grows with the budget but the number of rows.
    """
    placed = keyed.numbered(sources, [F.col("reputation").desc_nulls_last(), F.col("source_code")], "_place")
    affordable = F.col("_place") * F.lit(cost_each) <= F.lit(ceiling + 1e-9)
    return placed.select("source_code", "reputation", F.when(affordable, "CRAWL").otherwise("DEFER").alias("decision"))


def crawl_decisions(log: DataFrame) -> DataFrame:
    """Fetches in order per source: unchanged content hash means skip.

    ``log``: log_id, source_code, content_hash, logged_at. A skipped fetch has the
    stored hash by definition, so the stored hash is always the previous one.
    """
    previous = keyed.carry_forward(
        log, ["source_code"], "logged_at", "log_id", F.col("content_hash"), "_last"
    )
    same = F.coalesce(F.col("_last") == F.col("content_hash"), F.lit(False))
    return previous.select(
        "log_id", "source_code", "content_hash", F.when(same, "SKIP").otherwise("PROCEED").alias("decision")
    )


def with_stored(log: DataFrame, **others: Column) -> DataFrame:
    """Adds the ETag and Last-Modified of the source's last PROCEED entry before each entry, and the last of ``others``."""
    kept = F.when(F.col("action") == "PROCEED", F.struct("etag", "last_modified"))
    values = {"_last": (kept, []), **{name: (value, []) for name, value in others.items()}}
    found = keyed.carry_several(log, ["source_code"], "logged_at", "log_id", values)
    return found.select(*log.columns, F.col("_last.etag").alias("_e"), F.col("_last.last_modified").alias("_m"), *others)


def header_match(log: DataFrame, requests: Column) -> DataFrame:
    """ETag / Last-Modified of the entries that are ``requests`` against the last PROCEED entry before them."""
    same = (F.col("etag") == F.col("_e")) | (F.col("last_modified") == F.col("_m"))
    return with_stored(log).filter(requests).select(
        "source_code", "etag", "last_modified", "log_id",
        F.when(F.coalesce(same, F.lit(False)), "SKIP").otherwise("PROCEED").alias("decision"),
    )


def crawl_decision(log: DataFrame) -> DataFrame:
    """Whether each entry's fetch was worth it: ETag, then Last-Modified, then content hash; first match wins.

    Headers are compared with the source's last PROCEED entry before the entry, the hash with
    the last one stored for the source. Empty headers and missing content match nothing.
    """
    stored = with_stored(log, _hash=F.col("content_hash"))

    def same(a: str, b: str) -> Column:
        return F.coalesce((F.col(a) != "") & (F.col(a) == F.col(b)), F.lit(False))

    reason = (
        F.when(same("etag", "_e"), "etag match").when(same("last_modified", "_m"), "last_modified match")
        .when(same("content_hash", "_hash"), "content hash match").otherwise("change detected")
    )
    return stored.withColumn("reason", reason).select(
        "log_id", "source_code", F.when(F.col("reason") == "change detected", "PROCEED").otherwise("SKIP").alias("decision"), "reason"
    )


def latest_hash(log: DataFrame) -> DataFrame:
    return keyed.latest(
        log.filter(F.col("content_hash").isNotNull()), ["source_code"], [F.col("logged_at"), F.col("log_id")], ["content_hash"]
    )


# --- Blocks -----------------------------------------------------------------

def block_state(blocks: DataFrame, as_of: Column) -> DataFrame:
    """Cooldown ladder by number of blocks; the third block is for good.

    Only the count and the last block time matter, so this is one aggregate.
    """
    per = blocks.groupBy("source_url").agg(F.count(F.lit(1)).alias("block_count"), F.max("blocked_at").alias("last_block"))
    forever = F.col("block_count") >= K.BLOCKS_UNTIL_PERMANENT
    hours = F.element_at(F.array(*[F.lit(h) for h in K.BLOCK_COOLDOWN_HOURS]), F.least(F.col("block_count"), F.lit(2)).cast("int"))
    until = F.when(~forever, F.timestamp_add("HOUR", hours, F.col("last_block")))
    return per.select(
        "source_url", "block_count", forever.alias("is_permanent"), until.alias("cooldown_until"),
        (forever | F.coalesce(until > as_of, F.lit(False))).alias("is_blocked"),
    )


# --- Costs ------------------------------------------------------------------

def priced(events: DataFrame) -> DataFrame:
    """Cost in USD of every metered event (tokens, crawl seconds or bytes in ``quantity``)."""
    rate = F.coalesce(lookup(F.upper(F.col("provider")), K.LLM_RATE_PER_1K), F.lit(K.LLM_DEFAULT_RATE))
    n = F.col("quantity")
    cost = (
        F.when(F.col("category") == "LLM", n / F.lit(1000.0) * rate)
        .when(F.col("category") == "CRAWLER", n * F.lit(K.CRAWLER_RATE_PER_SECOND))
        .when(F.col("category") == "STORAGE", n / F.lit(float(2**30)) * F.lit(K.STORAGE_RATE_PER_GB))
    )
    return events.withColumn("cost_usd", cost)


def cost_report(costs: DataFrame) -> DataFrame:
    """Per source: total, events, and one column per category.

    Costs are summed as picodollars (wide integers), so totals do not depend on order.
    """
    pico = F.floor(F.col("cost_usd") * 1e12 + 0.5).cast("decimal(28,0)")

    def total(category: str | None) -> Column:
        part = pico if category is None else F.when(F.col("category") == category, pico)
        return F.coalesce(F.sum(part).cast("double"), F.lit(0.0)) / 1e12

    return costs.groupBy("source_id").agg(
        total(None).alias("total_cost_usd"), F.count(F.lit(1)).alias("event_count"),
        *[total(c).alias(f"{c.lower()}_usd") for c in ("LLM", "CRAWLER", "STORAGE")],
    )


def top_cost_sources(costs: DataFrame, n: int = 20) -> DataFrame:
    return cost_report(costs).select("source_id", "total_cost_usd").orderBy(
        F.col("total_cost_usd").desc(), "source_id"
    ).limit(n)


# --- Retention and erasure --------------------------------------------------

def retention_split(rows: DataFrame, cutoff: Column, stamps: list[str]) -> DataFrame:
    """Marks rows to archive: any of the timestamps lies before the cutoff."""
    old = F.lit(False)
    for s in stamps:
        old = old | F.coalesce(F.col(s) < cutoff, F.lit(False))
    return rows.withColumn("archive", old)


def retention_audit(split: DataFrame, table_name: str, cutoff: Column) -> DataFrame:
    return split.agg(F.count_if("archive").alias("records_deleted"), F.count_if(~F.col("archive")).alias("records_kept")).select(
        F.lit(table_name).alias("table_name"), "records_deleted", "records_kept", cutoff.alias("date_range_end")
    )


def archive_and_keep(split: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Writes rows marked by ``retention_split`` into an archive and a keep folder; returns both, read back."""
    split.write.mode("errorifexists").partitionBy("archive").parquet(path)
    whole = split.sparkSession.read.schema(split.schema).parquet(path)
    return whole.filter("archive").drop("archive"), whole.filter("NOT archive").drop("archive")


def chat_audit(sessions: DataFrame, messages: DataFrame, cutoff: Column) -> DataFrame:
    """Audit row for chats: sessions last active before the cutoff go, with their messages."""
    marked = sessions.select("session_id", (F.col("last_active") < cutoff).alias("archive"))
    rows = marked.select("archive").unionByName(messages.join(marked, "session_id").select("archive"))
    return retention_audit(rows, "chat_sessions+chat_messages", cutoff)


def expired_sessions(sessions: DataFrame, cutoff: Column) -> DataFrame:
    return sessions.filter(F.col("last_active") < cutoff)


def without_sessions(messages: DataFrame, gone: DataFrame) -> DataFrame:
    """Messages of the sessions that stay."""
    return messages.join(gone.select(F.col("session_id").alias("_sid")), F.col("session_id") == F.col("_sid"), "left_anti")


def erase_user(messages: DataFrame, sessions: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages and sessions left after every session of the given users is erased."""
    gone = sessions.join(users.select(F.col("user_id").alias("_u")), F.col("user_id") == F.col("_u"), "left_semi")
    return without_sessions(messages, gone), without_sessions(sessions, gone)


def erasure_audit(users: DataFrame, at: Column) -> DataFrame:
    """One audit row per erased user; counts aren't recorded for erasures."""
    return users.select(
        "user_id", F.lit("chat_sessions+chat_messages (user erasure)").alias("table_name"), F.lit(-1).cast("bigint").alias("records_deleted"),
        at.alias("date_range_end"), F.lit("GDPR Article 17 - Right to Erasure").alias("compliance_context"),
    )


# --- Consent ----------------------------------------------------------------

def consent_state(events: DataFrame) -> DataFrame:
    """Granted and not revoked since, per hashed user and type."""
    grant, revoke = F.col("action") == "grant", F.col("action") == "revoke"
    at = F.struct("noted_at", "event_id")
    state = events.groupBy("user_id", "consent_type").agg(
        F.max(F.when(grant, at)).alias("_g"), F.max(F.when(revoke, at)).alias("_r")
    )
    live = F.col("_g").isNotNull() & (F.col("_r").isNull() | (F.col("_g") > F.col("_r")))
    return state.select(
        F.sha2(F.col("user_id").cast("string"), 256).alias("user_id_hash"), "consent_type",
        F.col("_g.noted_at").alias("granted_at"), F.when(~live, F.col("_r.noted_at")).alias("revoked_at"), live.alias("is_active"),
    )


# --- Policies ---------------------------------------------------------------

def policy_versions(policies: DataFrame) -> DataFrame:
    """Validity interval of every version; publishing a version ends the one before."""
    following = keyed.carry(
        policies, ["policy_name"], "effective_date", "policy_id", F.struct("effective_date"), "_next", "YEAR", forward=False
    )
    return following.withColumn("valid_to", F.col("_next.effective_date")).withColumn(
        "is_active", F.col("_next").isNull()
    ).drop("_next")


def active_policies(policies: DataFrame) -> DataFrame:
    payload = [c for c in policies.columns if c != "policy_name"]
    return keyed.latest(policies, ["policy_name"], [F.col("effective_date"), F.col("policy_id")], payload)


def policy_thresholds(active: DataFrame) -> DataFrame:
    """Thresholds in force, defaults where a policy does not state them."""
    return active.select("policy_name", *[
        F.coalesce(F.col(name), F.lit(value)).alias(name) for name, value in K.POLICY_THRESHOLD_DEFAULTS.items()
    ])


# --- Profile ----------------------------------------------------------------

V1_SOURCES = "spark.sql.sources.useV1SourceList"
FOOTERS = {V1_SOURCES: "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}


@contextmanager
def from_footers(spark: SparkSession):
    """Inside, counts of Parquet tables are pushed down to their footers: no column is read."""
    before = {k: spark.conf.get(k, None) for k in FOOTERS}
    for k, v in FOOTERS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def counted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"))


def profile(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """table_name, n_rows, n_bytes of stored Parquet tables (name -> path), from footers and file listings."""
    rows = []
    for name, path in tables.items():
        with from_footers(spark):
            n = counted(spark, path).head()["n_rows"]
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
        size = files.agg(F.sum("length").alias("n")).head()["n"]  # a listing: contents aren't read
        rows.append((name, n, size or 0))
    return spark.createDataFrame(rows, "table_name string, n_rows bigint, n_bytes bigint")


def store_measurement(measured: DataFrame, path: str, at: Column) -> None:
    """Append a profile as one measurement row: time, bytes in all, and rows per table."""
    names = [r["table_name"] for r in measured.select("table_name").collect()]
    measured.agg(
        F.sum("n_bytes").alias("db_size_bytes"), *[F.sum(F.when(F.col("table_name") == n, F.col("n_rows"))).alias(f"{n}_rows") for n in names]
    ).withColumn("measured_at", at).write.mode("append").parquet(path)


def measured_trend(measurements: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Stored measurements of the last days, oldest first."""
    rest = [c for c in measurements.columns if c != "measured_at"]
    return since(measurements, "measured_at", as_of, days).orderBy("measured_at").select(F.col("measured_at").cast("date").alias("date"), *rest)


def missing_vectors(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """Records with and without a vector. ``vectors``: record_id."""
    have = vectors.select(F.col("record_id").alias("_v"))
    return records.join(have, F.col("record_id") == F.col("_v"), "left").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("_v").isNull()).alias("missing")
    )


# --- Summaries --------------------------------------------------------------

def cached_summaries(summaries: DataFrame, as_of: Column, hours: int = K.SUMMARY_TTL_HOURS) -> DataFrame:
    """Newest summary per (scope, type) still inside its lifetime."""
    fresh = summaries.filter(F.col("generated_at") >= F.timestamp_add("HOUR", F.lit(-hours), as_of))
    payload = [c for c in summaries.columns if c not in ("scope", "summary_type")]
    return keyed.latest(fresh, ["scope", "summary_type"], [F.col("generated_at"), F.col("summary_id")], payload)


def list_summaries(summaries: DataFrame, scope: str | None = None, kind: str | None = None, limit: int = 20) -> DataFrame:
    out = summaries
    if scope:
        out = out.filter(F.col("scope") == scope)
    if kind:
        out = out.filter(F.col("summary_type") == kind)
    return out.orderBy(F.col("generated_at").desc(), "summary_id").limit(limit)
