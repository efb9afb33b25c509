"""Crawl economy, cost, retention, consent, policy and profile queries."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import text
from tidemark.functions.numeric import rnd
from tidemark.operators import published as P
from tidemark.operators import upkeep as U
from tidemark.plans import sqlviews as V
from tidemark.plans.catalog import query
from tidemark.plans.medallion import silver
from tidemark.session import fresh_path
from tidemark.sources import sinks, views
from tidemark.sources.tables import source_dim, table

AS_OF = partial(views.clock, views.AS_OF_EVENTS)
AS_OF_O = partial(views.clock, views.AS_OF_ORDERS)


@query("crawl_efficiency", uses=["crawl_log"], sql=f"""
  SELECT count(*) FILTER (action IN ('SKIP', 'PROCEED')) AS scheduled, count(*) FILTER (action = 'SKIP') AS skipped,
    {V.rnd("count(*) FILTER (action = 'SKIP') * 100 / count(*) FILTER (action IN ('SKIP', 'PROCEED'))", 2)} AS skip_rate_pct,
    {V.rnd("count(*) FILTER (action = 'SKIP') * 0.00006::DOUBLE", 6)} AS saved_usd, count(DISTINCT source_code) FILTER (action = 'DEFER') AS sources_deferred
  FROM v_crawl_log WHERE logged_at >= {V.E} - INTERVAL 7 DAY""")
def crawl_efficiency(spark, folder):
    return U.crawl_efficiency(views.crawl_log(spark, folder), AS_OF())


@query("crawl_deferred", uses=["crawl_log"], sql=f"""
  SELECT DISTINCT source_code FROM v_crawl_log WHERE logged_at >= {V.E} - INTERVAL 7 DAY AND action = 'DEFER'""")
def crawl_deferred(spark, folder):
    return U.deferred_sources(views.crawl_log(spark, folder), AS_OF())


@query("crawl_budget", uses=["supply_sources"], sql="""
  SELECT source_code, reputation, CASE WHEN sum(0.25) OVER (ORDER BY reputation DESC, source_code ROWS UNBOUNDED PRECEDING) <= 10 THEN 'CRAWL' ELSE 'DEFER' END AS decision
  FROM v_supply_sources""")
def crawl_budget(spark, folder):
    return U.crawl_budget(views.supply_sources(spark, folder), 0.25)


@query("content_change", uses=["crawl_log"], sql="""
  SELECT log_id, source_code, content_hash, CASE WHEN lag(content_hash) OVER (PARTITION BY source_code ORDER BY logged_at, log_id) = content_hash
    THEN 'SKIP' ELSE 'PROCEED' END AS decision FROM v_crawl_log""")
def content_change(spark, folder):
    return U.crawl_decisions(views.crawl_log(spark, folder))


_HEADERS = """
  WITH l AS (SELECT *, 'e' || CAST(log_id % 3 AS VARCHAR) AS etag, 'm' || CAST(log_id % 5 AS VARCHAR) AS lm FROM v_crawl_log),
  p AS (SELECT *, last_value(CASE WHEN action = 'PROCEED' THEN {'e': etag, 'm': lm} END IGNORE NULLS) OVER w AS last,
      lag(content_hash) OVER (PARTITION BY source_code ORDER BY logged_at, log_id) AS stored
    FROM l WINDOW w AS (PARTITION BY source_code ORDER BY logged_at, log_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _headers(spark, folder):
    return views.crawl_log(spark, folder).withColumns({
        "etag": F.concat(F.lit("e"), (F.col("log_id") % 3).cast("string")),
        "last_modified": F.concat(F.lit("m"), (F.col("log_id") % 5).cast("string")),
    })


@query("header_match", uses=["crawl_log"], sql=_HEADERS + """
  SELECT source_code, etag, lm AS last_modified, log_id, CASE WHEN coalesce(etag = last.e OR lm = last.m, false) THEN 'SKIP' ELSE 'PROCEED' END AS decision FROM p WHERE action = 'DEFER'""")
def header_match(spark, folder):
    """Deferred fetches are checked against the last fetch before them that went through."""
    return U.header_match(_headers(spark, folder), F.col("action") == "DEFER")


@query("crawl_decision", uses=["crawl_log"], sql=_HEADERS + """
  , r AS (SELECT log_id, source_code, CASE WHEN coalesce(etag = last.e, false) THEN 'etag match' WHEN coalesce(lm = last.m, false) THEN 'last_modified match'
      WHEN coalesce(content_hash = stored, false) THEN 'content hash match' ELSE 'change detected' END AS reason FROM p)
  SELECT log_id, source_code, CASE WHEN reason = 'change detected' THEN 'PROCEED' ELSE 'SKIP' END AS decision, reason FROM r""")
def crawl_decision(spark, folder):
    """ETag, Last-Modified and content hash of every fetch in one decision."""
    return U.crawl_decision(_headers(spark, folder))


@query("latest_hash", uses=["crawl_log"], sql="""
  SELECT source_code, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY source_code ORDER BY logged_at DESC, log_id DESC) AS k FROM v_crawl_log) WHERE k = 1""")
def latest_hash(spark, folder):
    return U.latest_hash(views.crawl_log(spark, folder))


@query("page_hashes", sql="""
  SELECT page_id, substr(sha256(html), 1, 16) AS content_hash, sha256(url || '2024-02-01') AS url_hash FROM pages""")
def page_hashes(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", text.short_hash(F.col("html")).alias("content_hash"),
        text.daily_ip_hash(F.col("url"), AS_OF().cast("date")).alias("url_hash"),
    )


@query("block_state", uses=["blocks"], sql=f"""
  WITH b AS (SELECT source_url, count(*) AS block_count, max(blocked_at) AS l FROM v_blocks GROUP BY ALL),
  s AS (SELECT source_url, block_count, block_count >= 3 AS is_permanent, CASE block_count WHEN 1 THEN l + INTERVAL 1 HOUR WHEN 2 THEN l + INTERVAL 4 HOUR END AS cooldown_until FROM b)
  SELECT *, is_permanent OR coalesce(cooldown_until > {V.E}, false) AS is_blocked FROM s""")
def block_state(spark, folder):
    return U.block_state(views.blocks(spark, folder), AS_OF())


_PRICED = """pr AS (SELECT *, CASE category WHEN 'LLM' THEN quantity / 1000e0 * CASE provider WHEN 'groq' THEN 0e0 WHEN 'gemini' THEN 0.00015::DOUBLE WHEN 'cerebras' THEN 0e0 ELSE 0.001::DOUBLE END
    WHEN 'CRAWLER' THEN quantity * 0.000001::DOUBLE ELSE quantity / 1073741824e0 * 0.023::DOUBLE END AS cost FROM v_cost_events WHERE occurred_at >= TIMESTAMP '2024-02-01' - INTERVAL 30 DAY),
  cs AS (SELECT source_id, CAST(sum(CAST(floor(cost * 1e12 + 0.5) AS BIGINT)) AS BIGINT) / 1e12 AS total_cost_usd, count(*) AS event_count,
    coalesce(CAST(sum(CAST(floor(cost * 1e12 + 0.5) AS BIGINT)) FILTER (category = 'LLM') AS BIGINT), 0) / 1e12 AS llm_usd,
    coalesce(CAST(sum(CAST(floor(cost * 1e12 + 0.5) AS BIGINT)) FILTER (category = 'CRAWLER') AS BIGINT), 0) / 1e12 AS crawler_usd,
    coalesce(CAST(sum(CAST(floor(cost * 1e12 + 0.5) AS BIGINT)) FILTER (category = 'STORAGE') AS BIGINT), 0) / 1e12 AS storage_usd FROM pr GROUP BY ALL)"""


def _costs(spark, folder):
    return U.priced(U.since(views.cost_events(spark, folder), "occurred_at", AS_OF(), 30))


@query("cost_report", uses=["cost_events"], sql=f"WITH {_PRICED} SELECT * FROM cs")
def cost_report(spark, folder):
    return U.cost_report(_costs(spark, folder))


@query("cost_top20", uses=["cost_events"], sql=f"WITH {_PRICED} SELECT source_id, total_cost_usd FROM cs ORDER BY total_cost_usd DESC, source_id LIMIT 20")
def cost_top20(spark, folder):
    return U.top_cost_sources(_costs(spark, folder))


@query("supply_cost_top20", uses=["supply"], sql="""
  WITH p AS (SELECT source_code AS source_id, CAST(floor(tokens / 1000e0 * CASE provider WHEN 'groq' THEN 0e0 WHEN 'gemini' THEN 0.00015::DOUBLE WHEN 'cerebras' THEN 0e0 ELSE 0.001::DOUBLE END * 1e12 + 0.5) AS BIGINT) AS c FROM v_supply)
  SELECT source_id, CAST(sum(c) AS BIGINT) / 1e12 AS total_cost_usd FROM p GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 20""")
def supply_cost_top20(spark, folder):
    events = views.supply(spark, folder).select(
        F.col("source_code").alias("source_id"), F.lit("LLM").alias("category"), "provider", F.col("tokens").alias("quantity")
    )
    return U.top_cost_sources(U.priced(events))


@query("retention_split", uses=["bronze"], sql=f"""
  SELECT record_id, crawled_at < {V.E} - INTERVAL 90 DAY AS archive FROM v_bronze""")
def retention_split(spark, folder):
    cutoff = F.timestamp_add("DAY", F.lit(-90), AS_OF())
    return U.retention_split(views.bronze(spark, folder), cutoff, ["crawled_at"]).select("record_id", "archive")


@query("retention_archive", uses=["bronze"], sql=f"""
  SELECT CASE WHEN crawled_at < {V.E} - INTERVAL 15 DAY THEN 'archive' ELSE 'keep' END AS part, source_code, count(*) AS n, min(record_id) AS first_id, max(record_id) AS last_id
  FROM v_bronze GROUP BY ALL""")
def retention_archive(spark, folder):
    """Raw rows written to an archive and a keep table, both read back."""
    cutoff = F.timestamp_add("DAY", F.lit(-15), AS_OF())
    split = U.retention_split(views.bronze(spark, folder), cutoff, ["crawled_at"])
    out = []
    for part, rows in zip(("archive", "keep"), U.archive_and_keep(split, fresh_path(spark, "retention"))):
        out.append(rows.groupBy(F.lit(part).alias("part"), "source_code").agg(
            F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id")))
    return out[0].unionByName(out[1])


@query("retention_audit", uses=["gold", "sessions"], sql=f"""
  SELECT 'bronze_records' AS table_name, count(*) FILTER (crawled_at < {V.O} - INTERVAL 730 DAY) AS records_deleted,
    count(*) FILTER (crawled_at >= {V.O} - INTERVAL 730 DAY) AS records_kept, {V.O} - INTERVAL 730 DAY AS date_range_end FROM v_gold
  UNION ALL SELECT 'silver_records', count(*) FILTER (promoted_at < {V.O} - INTERVAL 1095 DAY), count(*) FILTER (promoted_at >= {V.O} - INTERVAL 1095 DAY), {V.O} - INTERVAL 1095 DAY FROM v_gold
  UNION ALL SELECT 'chat_sessions+chat_messages', count(*) FILTER (session_id % 180 > 90), count(*) FILTER (session_id % 180 <= 90), {V.O} - INTERVAL 90 DAY
    FROM (SELECT session_id FROM v_sessions UNION ALL SELECT session_id FROM v_messages)
  UNION ALL SELECT 'privacy_audit_log', count(*) FILTER (doc_id % 800 > 365), count(*) FILTER (doc_id % 800 <= 365), {V.O} - INTERVAL 365 DAY FROM documents""")
def retention_audit(spark, folder):
    """Deletion counts of all four policies: raw rows by crawl or load time, scored rows by processing
    time, chats by last activity, privacy log entries by redaction time."""
    def cutoff(policy):
        return F.timestamp_add("DAY", F.lit(-K.RETENTION_DAYS[policy]), AS_OF_O())

    def days_before(n):
        return F.timestamp_add("DAY", (-n).cast("int"), AS_OF_O())

    g = views.gold(spark, folder)
    out = []
    for name, policy, stamps in (("bronze_records", "bronze", ["crawled_at", "promoted_at"]), ("silver_records", "silver", ["promoted_at"])):
        out.append(U.retention_audit(U.retention_split(g, cutoff(policy), stamps), name, cutoff(policy)))
    sessions = views.sessions(spark, folder).withColumn("last_active", days_before(F.col("session_id") % 180))
    out.append(U.chat_audit(sessions, views.messages(spark, folder).select("session_id"), cutoff("chat")))
    log = table(spark, folder, "documents").select(days_before(F.col("doc_id") % 800).alias("redacted_at"))
    out.append(U.retention_audit(U.retention_split(log, cutoff("privacy_log"), ["redacted_at"]), "privacy_audit_log", cutoff("privacy_log")))
    return reduce(DataFrame.unionByName, out)


@query("chat_retention", uses=["sessions"], sql="""
  SELECT session_id, turn FROM v_messages WHERE session_id NOT IN (SELECT session_id FROM v_sessions WHERE last_active < 4)""")
def chat_retention(spark, folder):
    """Messages of sessions last active before turn 4 are dropped."""
    gone = U.expired_sessions(views.sessions(spark, folder), F.lit(4))
    return U.without_sessions(views.messages(spark, folder), gone).select("session_id", "turn")


_FORGOTTEN = "SELECT c_custkey FROM customer WHERE c_nationkey = 3"


def _forgotten(spark, folder):
    """All users of one nation asked to be forgotten."""
    return table(spark, folder, "customer").filter(F.col("c_nationkey") == 3).select(F.col("c_custkey").alias("user_id"))


@query("erasure", uses=["sessions"], sql=f"""
  SELECT session_id, turn FROM v_messages WHERE session_id NOT IN (SELECT session_id FROM v_sessions WHERE user_id IN ({_FORGOTTEN}))""")
def erasure(spark, folder):
    left, _ = U.erase_user(views.messages(spark, folder), views.sessions(spark, folder), _forgotten(spark, folder))
    return left.select("session_id", "turn")


@query("erasure_sessions", uses=["sessions"], sql=f"""
  SELECT session_id, user_id FROM v_sessions WHERE user_id NOT IN ({_FORGOTTEN})""")
def erasure_sessions(spark, folder):
    _, left = U.erase_user(views.messages(spark, folder), views.sessions(spark, folder), _forgotten(spark, folder))
    return left.select("session_id", "user_id")


@query("erasure_audit", sql=f"""
  SELECT c_custkey AS user_id, 'chat_sessions+chat_messages (user erasure)' AS table_name, CAST(-1 AS BIGINT) AS records_deleted, {V.E} AS date_range_end,
    'GDPR Article 17 - Right to Erasure' AS compliance_context FROM customer WHERE c_nationkey = 3""")
def erasure_audit(spark, folder):
    return U.erasure_audit(_forgotten(spark, folder), AS_OF())


@query("consent_state", uses=["consent_events"], sql="""
  WITH s AS (SELECT user_id, consent_type, first(action ORDER BY noted_at DESC, event_id DESC) AS last, max(noted_at) FILTER (action = 'grant') AS g, max(noted_at) FILTER (action = 'revoke') AS r
    FROM v_consent_events GROUP BY ALL)
  SELECT sha256(CAST(user_id AS VARCHAR)) AS user_id_hash, consent_type, g AS granted_at, CASE WHEN last = 'revoke' THEN r END AS revoked_at, last = 'grant' AS is_active FROM s""")
def consent_state(spark, folder):
    return U.consent_state(views.consent_events(spark, folder))


# Each part brand is a policy, each part a published version of it.
_POL = """po AS (SELECT p_brand AS policy_name, p_partkey AS policy_id, TIMESTAMP '2020-01-01' + to_days(CAST(p_partkey % 1000 AS INT)) AS effective_date,
    CASE WHEN p_size % 3 = 0 THEN p_size / 100e0 END AS auto_accept_threshold, CASE WHEN p_size % 3 = 1 THEN p_size / 100e0 END AS review_threshold_low, CAST(NULL AS DOUBLE) AS reject_below FROM part)"""


def _policies(spark, folder):
    size = F.col("p_size")
    return table(spark, folder, "part").select(
        F.col("p_brand").alias("policy_name"), F.col("p_partkey").alias("policy_id"),
        F.timestamp_add("DAY", F.col("p_partkey") % 1000, views.clock("2020-01-01 00:00:00")).alias("effective_date"),
        F.when(size % 3 == 0, size / F.lit(100.0)).alias("auto_accept_threshold"),
        F.when(size % 3 == 1, size / F.lit(100.0)).alias("review_threshold_low"),
        F.lit(None).cast("double").alias("reject_below"),
    )


@query("policy_versions", sql=f"""
  WITH {_POL} SELECT policy_name, policy_id, effective_date, lead(effective_date) OVER w AS valid_to, lead(policy_id) OVER w IS NULL AS is_active
  FROM po WINDOW w AS (PARTITION BY policy_name ORDER BY effective_date, policy_id)""")
def policy_versions(spark, folder):
    return U.policy_versions(_policies(spark, folder)).select("policy_name", "policy_id", "effective_date", "valid_to", "is_active")


@query("policy_active", sql=f"""
  WITH {_POL} SELECT policy_name, coalesce(auto_accept_threshold, 0.85) AS auto_accept_threshold, coalesce(review_threshold_low, 0.7) AS review_threshold_low,
    coalesce(reject_below, 0.7) AS reject_below FROM (SELECT *, row_number() OVER (PARTITION BY policy_name ORDER BY effective_date DESC, policy_id DESC) AS k FROM po) WHERE k = 1""")
def policy_active(spark, folder):
    return U.policy_thresholds(U.active_policies(_policies(spark, folder)))


def _stored(folder, **paths):
    return {n: f"{folder}/{t}.parquet" for n, t in (("bronze", "events"), ("gold", "orders"), ("vectors", "embeddings"))} | paths


@query("resource_profile", uses=["silver"], sql="""
  SELECT table_name, n_rows, true AS has_bytes FROM (
    SELECT 'bronze' AS table_name, count(*) AS n_rows FROM events UNION ALL SELECT 'silver', count(*) FROM events UNION ALL SELECT 'gold', count(*) FROM orders
    UNION ALL SELECT 'review_queue', count(*) FROM v_silver WHERE dq_status = 'REVIEW' UNION ALL SELECT 'vectors', count(*) FROM embeddings)""")
def resource_profile(spark, folder):
    """Rows and bytes of the stored tables, Silver among them by routing status."""
    path = fresh_path(spark, "profiled-silver")
    sinks.write_routed(spark, silver(spark, folder), path)
    found = U.profile(spark, _stored(folder, silver=path, review_queue=f"{path}/dq_status=REVIEW"))
    return found.select("table_name", "n_rows", (F.col("n_bytes") > 0).alias("has_bytes"))


@query("resource_trend", sql=f"""
  SELECT CAST({V.E} - to_days(d) AS DATE) AS date, (SELECT count(*) FROM events) AS bronze_rows, (SELECT count(*) FROM orders WHERE o_orderkey % 4 <= k) AS gold_rows,
    (SELECT count(*) FROM embeddings) AS vectors_rows, true AS grows FROM (VALUES (1, 20), (2, 10), (3, 0)) t(k, d)""")
def resource_trend(spark, folder):
    """Gold grows by a quarter at a time and is measured each time; the first measurement is older than the trend."""
    gold, measured = fresh_path(spark, "profiled-gold"), fresh_path(spark, "measurements")
    for k, days in enumerate((40, 20, 10, 0)):
        table(spark, folder, "orders").where(F.col("o_orderkey") % 4 == k).write.mode("append").parquet(gold)
        U.store_measurement(U.profile(spark, _stored(folder, gold=gold)), measured, F.timestamp_add("DAY", F.lit(-days), AS_OF()))
    trend = U.measured_trend(spark.read.parquet(measured), AS_OF())
    before = F.lag("db_size_bytes").over(Window.partitionBy(F.lit(1)).orderBy("date"))
    return trend.withColumn("grows", F.coalesce(F.col("db_size_bytes") > before, F.lit(True))).drop("db_size_bytes")


@query("missing_vectors", sql="""
  SELECT count(*) AS total, count(*) FILTER (vec_id IS NULL) AS missing FROM orders LEFT JOIN embeddings ON o_orderkey = vec_id""")
def missing_vectors(spark, folder):
    records = table(spark, folder, "orders").select(F.col("o_orderkey").alias("record_id"))
    return U.missing_vectors(records, table(spark, folder, "embeddings").select(F.col("vec_id").alias("record_id")))


@query("distinct_pairs", uses=["gold"], sql="""
  SELECT DISTINCT indicator_code, country_code FROM v_gold WHERE tenant_id IS NULL OR tenant_id = 1""")
def distinct_pairs(spark, folder):
    return P.visible_to(views.gold(spark, folder), 1).select("indicator_code", "country_code").distinct()


@query("active_definitions", sql="""
  SELECT p_partkey AS definition_id, p_brand AS code FROM part WHERE p_size % 10 <> 0""")
def active_definitions(spark, folder):
    """Definitions (parts) without a deprecation mark."""
    marked = table(spark, folder, "part").withColumn("deprecated_at", F.when(F.col("p_size") % 10 == 0, AS_OF()))
    return marked.filter(F.col("deprecated_at").isNull()).select(F.col("p_partkey").alias("definition_id"), F.col("p_brand").alias("code"))


_SUMMARY = """sm AS (SELECT event_id AS summary_id, 'C' || CAST(user_id % 20 AS VARCHAR) AS scope, CASE event_type WHEN 'click' THEN 'COUNTRY_SNAPSHOT' WHEN 'view' THEN 'INDICATOR_BRIEF' ELSE 'SECTOR_ANALYSIS' END AS summary_type,
    ts AS generated_at FROM events)"""


def _summaries(spark, folder):
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("summary_id"), F.concat(F.lit("C"), (F.col("user_id") % 20).cast("string")).alias("scope"),
        F.when(kind == "click", "COUNTRY_SNAPSHOT").when(kind == "view", "INDICATOR_BRIEF").otherwise("SECTOR_ANALYSIS").alias("summary_type"),
        F.col("ts").cast("timestamp_ntz").alias("generated_at"),
    )


@query("summary_cache", sql=f"""
  WITH {_SUMMARY} SELECT scope, summary_type, summary_id, generated_at FROM (SELECT *, row_number() OVER (PARTITION BY scope, summary_type ORDER BY generated_at DESC, summary_id DESC) AS k
    FROM sm WHERE generated_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR) WHERE k = 1""")
def summary_cache(spark, folder):
    return U.cached_summaries(_summaries(spark, folder), views.clock("2024-01-30 12:00:00"))


@query("summary_list", sql=f"""
  WITH {_SUMMARY} SELECT * FROM sm WHERE scope = 'C7' AND summary_type = 'SECTOR_ANALYSIS' ORDER BY generated_at DESC, summary_id LIMIT 20""")
def summary_list(spark, folder):
    return U.list_summaries(_summaries(spark, folder), "C7", "SECTOR_ANALYSIS")


@query("source_activity", uses=["bronze"], sql=f"""
  WITH d AS (SELECT * FROM (VALUES {', '.join(f"({V.q(s[0])}, {V.q(s[1])}, {V.q(s[3])}, {s[4]}::DOUBLE)" for s in K.SOURCES)}) x(source_code, source_name, source_type, reputation))
  SELECT d.source_code, source_name, source_type, reputation, source_type IN ('HTML', 'PDF') AS crawlable, count(record_id) AS n_records, max(crawled_at) AS last_crawled_at
  FROM d LEFT JOIN v_bronze b ON d.source_code = b.source_code AND (tenant_id IS NULL OR tenant_id = 1) GROUP BY ALL""")
def source_activity(spark, folder):
    """Status of the active sources with what a tenant has received from each."""
    seen = P.visible_to(views.bronze(spark, folder), 1).groupBy(F.col("source_code").alias("_s")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("crawled_at").alias("last_crawled_at")
    )
    return source_dim(spark).filter("is_active").join(seen, F.col("source_code") == F.col("_s"), "left").select(
        "source_code", "source_name", "source_type", "reputation", F.col("source_type").isin(K.CRAWLABLE_TYPES).alias("crawlable"),
        F.coalesce("_n", F.lit(0)).alias("n_records"), "last_crawled_at",
    )
