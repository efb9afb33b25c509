"""Scorecard, freshness, fairness and oversight queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import scoring
from tidemark.functions.numeric import rnd
from tidemark.operators import governance as G
from tidemark.plans import sqlviews as V
from tidemark.plans.catalog import query
from tidemark.plans.medallion import silver
from tidemark.sources import sinks, views
from tidemark.sources.tables import country_dim, table

AS_OF = partial(views.clock, views.AS_OF_ORDERS)
AS_OF_E = partial(views.clock, views.AS_OF_EVENTS)

_CARDS = f"""
  WITH w AS (SELECT source_code, CAST(date_trunc('week', crawled_at) AS DATE) AS week_start, count(*) AS n, count(raw_value) AS ok,
      CAST(sum(dq_score) AS BIGINT) AS dq, count(*) FILTER (is_revision) AS rev, count(*) FILTER (severity <> 'ROUTINE') AS con FROM v_supply GROUP BY ALL),
  t AS (SELECT source_code, CAST(sum(n) AS BIGINT) AS tn, CAST(sum(con) AS BIGINT) AS tc FROM w GROUP BY ALL),
  g AS (SELECT source_code, has_error, CAST(unnest(generate_series(CAST((SELECT min(week_start) FROM w) AS TIMESTAMP), CAST((SELECT max(week_start) FROM w) AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week_start
    FROM v_supply_sources WHERE is_active),
  m AS (SELECT g.source_code, g.week_start, coalesce(ok / n * 100, 0) AS a, dq / n AS b, coalesce(rev / tn, 0) AS c, coalesce(tc / tn, 0) AS d, CASE WHEN has_error THEN 90e0 ELSE 95e0 END AS u
    FROM g LEFT JOIN w ON g.source_code = w.source_code AND g.week_start = w.week_start LEFT JOIN t ON g.source_code = t.source_code),
  cards AS (SELECT source_code, week_start, {V.rnd('a', 4)} AS extraction_success_rate, {V.rnd('b', 4)} AS avg_quality_score, {V.rnd('c', 6)} AS revision_frequency,
    {V.rnd('d', 6)} AS conflict_rate, u AS availability_uptime,
    {V.rnd('(a / 100 * 0.3::DOUBLE + coalesce(b, 80) / 100 * 0.3::DOUBLE + (1 - c) * 0.2::DOUBLE + (1 - d) * 0.1::DOUBLE + u / 100 * 0.1::DOUBLE) * 100', 4)} AS source_reputation_score FROM m)"""


def _cards(spark, folder):
    cards = G.scorecards(views.supply(spark, folder), views.supply_sources(spark, folder))
    return cards.select(
        "source_code", "week_start", rnd("extraction_success_rate", 4).alias("extraction_success_rate"),
        rnd("avg_quality_score", 4).alias("avg_quality_score"), rnd("revision_frequency", 6).alias("revision_frequency"),
        rnd("conflict_rate", 6).alias("conflict_rate"), "availability_uptime",
        rnd("source_reputation_score", 4).alias("source_reputation_score"),
    )


@query("scorecards_weekly", uses=["supply", "supply_sources"], sql=_CARDS + " SELECT * FROM cards")
def scorecards_weekly(spark, folder):
    return _cards(spark, folder)


@query("scorecards_latest", uses=["supply", "supply_sources"], sql=_CARDS + """
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source_code ORDER BY week_start DESC) AS rn FROM cards) WHERE rn = 1""")
def scorecards_latest(spark, folder):
    return G.latest_scorecards(_cards(spark, folder))


@query("sources_by_reputation", uses=["supply_sources"], sql="""
  SELECT source_code, reputation, has_error, is_active FROM v_supply_sources ORDER BY reputation DESC, source_code""")
def sources_by_reputation(spark, folder):
    return views.supply_sources(spark, folder).orderBy(F.col("reputation").desc(), "source_code")


_WATCHED = ", ".join(f"({V.q(c)}, {V.q(t)}, {K.SLA_WINDOW_MINUTES[t]})" for t, cs in K.SLA_TIERS.items() for c in cs)
_SLA = f"""
  WITH d AS (SELECT * FROM (VALUES {_WATCHED}) x(indicator_code, tier, window_minutes)),
  n AS (SELECT indicator_code AS c, max(crawled_at) AS last_crawled_at, first(country_code ORDER BY crawled_at DESC, record_id DESC) AS country_code FROM v_gold GROUP BY ALL),
  s AS (SELECT indicator_code, tier, window_minutes, last_crawled_at, country_code,
    coalesce({V.rnd(f"date_diff('microsecond', last_crawled_at, {V.O}) / 1e6 / 60", 2)}, -1) AS age_minutes,
    coalesce(date_diff('microsecond', last_crawled_at, {V.O}) / 1e6 / 60 <= window_minutes, false) AS compliant FROM d LEFT JOIN n ON indicator_code = c)"""


@query("sla_status", uses=["gold"], sql=_SLA + " SELECT * FROM s")
def sla_status(spark, folder):
    return G.sla_status(spark, views.gold(spark, folder), AS_OF()).withColumn("age_minutes", rnd("age_minutes", 2))


@query("sla_rollup", uses=["gold"], sql=_SLA + f"""
  SELECT coalesce(tier, 'ALL') AS tier, count(*) AS n, {V.rnd('count(*) FILTER (compliant) / count(*) * 100', 1)} AS compliance_pct FROM s GROUP BY ROLLUP (tier)""")
def sla_rollup(spark, folder):
    return G.sla_rollup(G.sla_status(spark, views.gold(spark, folder), AS_OF()))


@query("record_tiers", uses=["bronze"], sql=f"""
  SELECT source_code, tier, {V.case_map('tier', K.SLA_WINDOW_MINUTES)} AS window_minutes, count(*) AS n FROM (
    SELECT source_code, coalesce({V.case_map('indicator_code', {c: t for t, cs in K.SLA_TIERS.items() for c in cs})}, 'TIER3') AS tier FROM v_bronze) GROUP BY ALL""")
def record_tiers(spark, folder):
    return G.tiered(views.bronze(spark, folder)).groupBy("source_code", "tier", "window_minutes").agg(
        F.count(F.lit(1)).alias("n")
    )


_ALERTS = f"""SELECT record_id, indicator_code, country_code, CASE WHEN indicator_code = 'CPI_INFLATION' THEN 'CRITICAL' ELSE 'WARNING' END AS type,
    CASE WHEN indicator_code = 'CPI_INFLATION' THEN 'High Inflation Alert: ' || country_code || ' CPI is ' || {V.plain('value')} || '%'
      ELSE 'Negative Growth: ' || country_code || ' GDP growth is ' || {V.plain('value')} || '%' END AS message, promoted_at AS logged_at
  FROM v_gold WHERE promoted_at >= {V.O} - INTERVAL 30 DAY AND NOT is_forecast AND (tenant_id IS NULL OR tenant_id = 1)
    AND ((indicator_code = 'CPI_INFLATION' AND value > 5) OR (indicator_code = 'GDP_GROWTH' AND value < 0))"""


@query("alerts", uses=["gold"], sql=_ALERTS)
def alerts(spark, folder):
    return G.alerts(views.gold(spark, folder), AS_OF(), 1, days=30).drop("tenant_id")


@query("alerts_recent", uses=["gold"], sql=f"SELECT * FROM ({_ALERTS}) ORDER BY logged_at DESC, record_id LIMIT 20")
def alerts_recent(spark, folder):
    log = G.alerts(views.gold(spark, folder), AS_OF(), 1, days=30)
    return G.recent_alerts(log, 1).drop("tenant_id")


@query("audit_window", uses=["crawl_log"], sql=f"""
  SELECT log_id, action AS table_name, logged_at FROM v_crawl_log WHERE logged_at >= {V.E} - INTERVAL 10 DAY AND action = 'SKIP'
  ORDER BY logged_at DESC, log_id LIMIT 100""")
def audit_window(spark, folder):
    log = views.crawl_log(spark, folder).withColumnRenamed("action", "table_name")
    return G.audit_window(log, AS_OF_E(), 10, "SKIP").select("log_id", "table_name", "logged_at")


@query("coverage_report", uses=["gold"], sql=f"""
  WITH t AS (SELECT * FROM (VALUES {', '.join(f'({V.q(c)}, {V.q(K.COUNTRY_NAMES[c])})' for c in K.COUNTRIES)}) x(cc, nm)),
  s AS (SELECT country_code, count(DISTINCT indicator_code) AS n, max(crawled_at) AS last_updated FROM v_gold GROUP BY ALL)
  SELECT coalesce(country_code, cc) AS country_code, coalesce(nm, country_code, cc) AS country_name, coalesce(n, 0) AS indicators_covered, last_updated,
    {V.rnd('coalesce(n, 0) / 11 * 100', 4)} AS coverage_score,
    'Note: Data coverage for ' || coalesce(nm, country_code, cc) || ' is currently ' || {V.fixed('coalesce(n, 0) / 11 * 100', 0)} ||
    '%. Some indicators may be unavailable or sourced from limited providers.' AS notice FROM s FULL JOIN t ON country_code = cc""")
def coverage_report(spark, folder):
    out = G.coverage(views.gold(spark, folder), country_dim(spark))
    return out.withColumn("coverage_score", rnd("coverage_score", 4))


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("bias_alerts", uses=["sessions", "gold"], sql=f"""
  WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_active DESC, session_id DESC) AS rn FROM v_sessions) WHERE rn <= 30),
  u AS (SELECT user_id, count(*) AS session_count FROM s GROUP BY ALL),
  r AS (SELECT s.user_id, count(DISTINCT g.region) AS nr, max(g.region) AS dominant_region FROM s JOIN v_messages m ON m.session_id = s.session_id
    JOIN v_gold g ON g.record_id = m.record_id GROUP BY ALL),
  x AS (SELECT r.user_id, session_count, dominant_region, list_filter_ AS miss FROM r JOIN u USING (user_id),
    LATERAL (SELECT list(z ORDER BY z) AS list_filter_ FROM (SELECT unnest({REGIONS!r}) AS z) WHERE z <> dominant_region) WHERE nr = 1)
  SELECT sha256(CAST(user_id AS VARCHAR)) AS user_id_hash, user_id, session_count, dominant_region, array_to_string(miss, ',') AS other_regions_missing,
    'You''ve been exploring ' || dominant_region || ' data. Consider also looking at ' || array_to_string(miss[1:2], ', ') ||
    ' indicators for a broader perspective.' AS nudge FROM x""")
def bias_alerts(spark, folder):
    regions = views.gold(spark, folder).select("record_id", "region")
    return G.bias_alerts(views.sessions(spark, folder), views.messages(spark, folder), regions, REGIONS)


def _approvals(spark, folder):
    """System evaluations of every Silver row, plus the analysts' later decisions."""
    s = silver(spark, folder)
    system = s.select(
        F.col("record_id").alias("silver_id"), (F.col("record_id") * 2).alias("approval_id"), "dq_score",
        scoring.oversight_decision(F.col("dq_score")).alias("decision"), F.col("crawled_at").alias("decided_at"),
    )
    later = system.filter((F.col("decision") == "PENDING_REVIEW") & (F.col("silver_id") % 3 != 0)).select(
        "silver_id", (F.col("approval_id") + 1).alias("approval_id"), "dq_score",
        F.when(F.col("silver_id") % 3 == 1, "APPROVED").otherwise("REJECTED").alias("decision"),
        F.timestamp_add("HOUR", (F.col("silver_id") % 5) - 1, F.col("decided_at")).alias("decided_at"),
    )
    return system.unionByName(later)


@query("oversight_pending", uses=["silver"], sql="""
  SELECT record_id AS silver_id, record_id * 2 AS approval_id, dq_score, crawled_at AS decided_at FROM v_silver
  WHERE dq_score <= 90 AND dq_score >= 70 AND NOT (record_id % 3 <> 0 AND record_id % 5 - 1 > 0)""")
def oversight_pending(spark, folder):
    return G.oversight_pending(_approvals(spark, folder))


@query("escalations", uses=["tasks"], sql=f"""
  WITH e AS (SELECT *, status = 'PENDING' AND sla_deadline < {V.E} AS br FROM v_tasks)
  SELECT task_id, status, assigned_at, CASE WHEN br AND level < 5 THEN level + 1 ELSE level END AS level,
    CASE WHEN br AND level < 5 THEN {V.E} + to_hours(CASE level + 1 WHEN 3 THEN 8 WHEN 4 THEN 24 WHEN 5 THEN 48 ELSE 4 END) ELSE sla_deadline END AS sla_deadline,
    CASE WHEN br AND level < 5 THEN level END AS escalated_from, br AND level >= 5 AS stuck_at_top FROM e""")
def escalations(spark, folder):
    return G.escalate(views.tasks(spark, folder), AS_OF_E())


@query("open_tasks", uses=["tasks"], sql=f"""
  SELECT task_id, level, {V.case_map('level', K.LEVEL_NAMES)} AS level_name, sla_deadline,
    {V.rnd(f"greatest(0, date_diff('microsecond', {V.E}, sla_deadline) / 1e6 / 3600)", 4)} AS remaining_hours, sla_deadline < {V.E} AS sla_breached
  FROM v_tasks WHERE status = 'PENDING'""")
def open_tasks(spark, folder):
    return G.open_tasks(views.tasks(spark, folder), AS_OF_E()).withColumn("remaining_hours", rnd("remaining_hours", 4))


@query("decision_distribution", uses=["silver"], sql=f"""
  WITH d AS (SELECT CASE WHEN c >= 85 THEN 'AUTO_ACCEPT' WHEN c >= 70 THEN 'QUEUE_REVIEW' ELSE 'REJECT' END AS decision, c / 100e0 AS confidence FROM (
    SELECT record_id % 101 AS c, crawled_at FROM v_silver) WHERE crawled_at >= {V.E} - INTERVAL 7 DAY)
  SELECT decision, count(*) AS n, {V.rnd('count(*) / sum(count(*)) OVER () * 100', 1)} AS pct, {V.rnd('avg(confidence)', 4)} AS avg_confidence,
    {V.rnd('min(confidence)', 4)} AS min_confidence, {V.rnd('max(confidence)', 4)} AS max_confidence FROM d GROUP BY ALL""")
def decision_distribution(spark, folder):
    confidence = (F.col("record_id") % 101) / F.lit(100.0)
    decisions = views.bronze(spark, folder).select(
        confidence.alias("confidence"), scoring.confidence_decision(confidence).alias("decision"),
        F.col("crawled_at").alias("decided_at"),
    )
    return G.decision_distribution(decisions, AS_OF_E())


@query("scorecard_upsert", uses=["supply", "supply_sources"], sql=_CARDS + """
  SELECT source_code, week_start, CASE WHEN week_start >= DATE '2001-01-01' THEN 100e0 ELSE source_reputation_score END AS source_reputation_score FROM cards""")
def scorecard_upsert(spark, folder):
    """Recomputed cards of recent weeks replace the stored ones; the rest stays."""
    stored = _cards(spark, folder).select("source_code", "week_start", "source_reputation_score")
    recent = stored.filter(F.col("week_start") >= F.lit("2001-01-01").cast("date")).withColumn("source_reputation_score", F.lit(100.0))
    return sinks.merge_by_key(stored, recent, ["source_code", "week_start"])
