"""Lineage, trust, breakdown, citation-trail and trace queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import text
from tidemark.functions.numeric import rnd
from tidemark.operators import provenance as PV
from tidemark.plans import sqlviews as V
from tidemark.plans.catalog import CATALOG, query
from tidemark.plans.medallion import reviewed, silver, silver_once
from tidemark.operators import medallion as M
from tidemark.session import fresh_path
from tidemark.sources import views
from tidemark.sources.tables import table

_DIMS = list(K.DQ_WEIGHTS)


@query("quality_breakdown", uses=["silver"], sql=f"""
  WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY indicator_code, country_code, period ORDER BY crawled_at DESC, record_id DESC) AS k FROM v_silver) WHERE k = 1),
  r AS (SELECT indicator_code, country_code, period, record_id, {', '.join(f"CASE WHEN record_id % 10 = 0 THEN dq_score ELSE {d} END AS {d}" for d in _DIMS)} FROM l)
  SELECT *, {', '.join(f"{V.rnd(f'{d} * {w}::DOUBLE', 4)} AS {d}_weighted" for d, w in K.DQ_WEIGHTS.items())},
    {V.rnd(' + '.join(f'{d} * {w}::DOUBLE' for d, w in K.DQ_WEIGHTS.items()), 2)} AS overall_score FROM r""")
def quality_breakdown(spark, folder):
    """Every tenth Silver row has lost its sub-scores and falls back to the overall score."""
    s = silver(spark, folder).withColumns({
        "processed_at": F.col("crawled_at"), **{d: F.when(F.col("record_id") % 10 != 0, F.col(d)) for d in _DIMS},
    })
    return PV.quality_breakdown(s)


def _lineage(spark, folder):
    scored = silver_once(spark, folder)
    edges = table(spark, folder, "events").select(
        (F.col("event_id") * 2).alias("edge_id"), F.col("event_id").alias("source_record_id"),
        F.floor(F.col("event_id") / 2).alias("target_record_id"),
    )
    return PV.lineage(views.gold(spark, folder), scored, reviewed(scored), edges)


_EDGE = "ed AS (SELECT node, count(*) AS n FROM (SELECT event_id // 2 AS node FROM events UNION ALL SELECT event_id FROM events WHERE event_id <> event_id // 2) GROUP BY ALL)"
_REV = """rv AS (SELECT record_id AS rb, CASE record_id % 4 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'ADJUSTED' WHEN 2 THEN 'REJECTED' ELSE 'PENDING' END AS review_status,
    CASE WHEN record_id % 4 <> 3 THEN 'analyst' || CAST(record_id % 3 AS VARCHAR) END AS reviewed_by FROM v_silver WHERE dq_status = 'REVIEW')"""


@query("lineage_explain", uses=["gold", "silver"], sql=f"""
  WITH {_EDGE}, {_REV}
  SELECT g.record_id, g.indicator_code, s.record_id AS bronze_id, s.source_code AS bronze_source, s.dq_status, s.dq_score AS silver_dq, review_status, rv.reviewed_by, coalesce(ed.n, 0) AS n_lineage
  FROM v_gold g LEFT JOIN v_silver s ON g.silver_id = s.record_id LEFT JOIN rv ON s.record_id = rb LEFT JOIN ed ON g.record_id = node""")
def lineage_explain(spark, folder):
    return _lineage(spark, folder).select(
        "record_id", "indicator_code", "bronze_id", "bronze_source", "dq_status", "silver_dq", "review_status", "reviewed_by", "n_lineage"
    )


def _reason_sql(r: str) -> str:
    below, above = f"regexp_extract({r}, '^value_(.*)_below_min_(.*)$', ", f"regexp_extract({r}, '^value_(.*)_above_max_(.*)$', "
    known = " ".join(f"WHEN {r} = {V.q(k)} THEN {V.q(v)}" for k, v in K.REASON_SENTENCES.items())
    return f"""CASE {known}
      WHEN {below}1) <> '' THEN 'Value ' || {below}1) || ' is below the minimum plausible bound (' || {below}2) || ').'
      WHEN {above}1) <> '' THEN 'Value ' || {above}1) || ' exceeds the maximum plausible bound (' || {above}2) || ').'
      WHEN {r} LIKE 'data!_%!_years!_old' ESCAPE '!' THEN 'Data is ' || regexp_extract({r}, '^data_(.*)_years_old$', 1) || ' years old relative to the current year.'
      WHEN {r} LIKE 'crawled!_%!_days!_ago' ESCAPE '!' THEN 'Record was crawled ' || regexp_extract({r}, '^crawled_(.*)_days_ago$', 1) || ' days ago (may affect freshness score).'
      WHEN {r} LIKE 'unit!_mismatch%' ESCAPE '!' THEN 'Unit mismatch detected: ' || replace({r}, 'unit_mismatch_', '') || '.'
      ELSE {r} END"""


_TRUST = f"""
  WITH {_REV},
  j AS (SELECT g.record_id, g.dq_score AS dq, g.source_code AS src, g.approved_by, s.record_id AS sid, s.dq_status, s.reasons, {', '.join('s.' + d for d in _DIMS)}, review_status, rv.reviewed_by
    FROM v_gold g LEFT JOIN v_silver s ON g.silver_id = s.record_id LEFT JOIN rv ON s.record_id = rb),
  t AS (SELECT *, CASE WHEN dq >= 90 THEN 'high' WHEN dq >= 70 THEN 'medium' ELSE 'low' END AS trust_tier,
    CASE WHEN review_status IN ('APPROVED', 'ADJUSTED') THEN 'HUMAN_REVIEW_' || review_status WHEN dq_status IS NOT NULL THEN dq_status
      WHEN approved_by <> 'auto' THEN 'HUMAN_APPROVED' ELSE 'AUTO_PROMOTED' END AS promotion_path,
    {', '.join(f'coalesce({d}, 0) AS s_{d}' for d in _DIMS)} FROM j),
  rs AS (SELECT sid, string_agg({_reason_sql('r')}, '; ' ORDER BY i) AS human FROM (SELECT sid, unnest(string_split(reasons, ';')) AS r, unnest(range(len(string_split(reasons, ';')))) AS i FROM t WHERE reasons <> '') GROUP BY sid),
  w AS (SELECT t.record_id, trust_tier, promotion_path,
    concat_ws('; ', 'Composite DQ score is ' || {V.fixed('dq', 1)} || '% {K.TRUST_MODEL}', CASE WHEN trust_tier = 'high' THEN {V.q(K.TRUST_HIGH)} END,
      CASE WHEN promotion_path LIKE 'HUMAN!_REVIEW%' ESCAPE '!' THEN 'An analyst reviewed this record (' || review_status || ')' || CASE WHEN reviewed_by <> '' THEN ' — ' || reviewed_by ELSE '' END || ' before it reached Gold.'
        WHEN approved_by <> 'auto' THEN 'Approved for Gold by ' || approved_by || '.' END,
      'Sourced from ' || src || '.', CASE WHEN t.sid IS NOT NULL THEN 'Ingested via api fetch.' END,
      {', '.join(f"CASE WHEN s_{d} >= 90 THEN '{K.DIMENSION_LABELS[d]} scored ' || {V.fixed(f's_{d}', 0)} || '% — no material issues.' END" for d in _DIMS)}) AS why,
    concat_ws('; ', CASE trust_tier WHEN 'medium' THEN {V.q(K.TRUST_MEDIUM)} WHEN 'low' THEN {V.q(K.TRUST_LOW)} END,
      {', '.join(f"CASE WHEN s_{d} < 70 THEN '{K.DIMENSION_LABELS[d]} scored only ' || {V.fixed(f's_{d}', 0)} || '%.' END" for d in _DIMS)}, human) AS caveats, dq
    FROM t LEFT JOIN rs ON t.sid = rs.sid)
  SELECT record_id, trust_tier, promotion_path, why, caveats, concat_ws(' ', 'DQ ' || {V.fixed('dq', 1)} || '% (' || lower({V.case_map('trust_tier', K.TRUST_LABELS)}) || ').',
    CASE WHEN promotion_path LIKE 'HUMAN%' THEN 'Human-reviewed before Gold.' ELSE 'Automated pipeline promotion.' END, CASE WHEN caveats = '' THEN 'No outstanding quality flags.' END) AS summary FROM w"""


@query("trust_explanation", uses=["gold", "silver"], sql=_TRUST)
def trust_explanation(spark, folder):
    rows = _lineage(spark, folder).withColumns({
        "review_notes": F.lit(None).cast("string"), "source_name": F.col("source_code"),
        "extraction_method": F.when(F.col("bronze_id").isNotNull(), "API_FETCH"),
    })
    return PV.with_trust(rows).select(
        "record_id", "trust_tier", "promotion_path", F.array_join("why_trustable", "; ").alias("why"),
        F.array_join("caveats", "; ").alias("caveats"), "summary",
    )


@query("failure_reasons", uses=["silver"], sql=f"""
  WITH x AS (SELECT record_id, unnest(string_split(reasons, ';')) AS reason FROM v_silver WHERE reasons <> '')
  SELECT record_id, reason, {_reason_sql('reason')} AS sentence, CASE WHEN reason LIKE 'missing!_%' ESCAPE '!' THEN 'completeness' WHEN reason LIKE 'value!_%' ESCAPE '!' THEN 'accuracy'
    WHEN contains(reason, 'years_old') OR reason LIKE 'crawled!_%' ESCAPE '!' OR contains(reason, 'period_format') THEN 'timeliness' WHEN contains(reason, 'unit') THEN 'consistency' ELSE 'accuracy' END AS dimension FROM x""")
def failure_reasons(spark, folder):
    return silver(spark, folder).select("record_id", F.explode("failure_reasons").alias("reason")).select(
        "record_id", "reason", text.reason_sentence(F.col("reason")).alias("sentence"), text.reason_dimension(F.col("reason")).alias("dimension")
    )


def _accesses(spark, folder, gold):
    """Every line item is one look-up of the record it belongs to."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    return lines.join(gold.select("record_id", "indicator_code", "country_code", "period"), F.col("l_orderkey") == F.col("record_id")).select(
        "indicator_code", "country_code", "period", F.when(F.col("l_linenumber") % 2 == 0, "chatbot").otherwise("api").alias("access_type"),
        "l_linenumber",
    )


def _flat_trails(trails):
    return trails.select(
        "trail_id", "indicator_code", "country_code", "period", "level2.record_id", rnd("level1.value", 6).alias("value"),
        "level1.source_code", "level3.chatbot_sessions_count", "level3.api_calls_count",
    )


@query("citation_trail", uses=["gold"], sql=f"""
  WITH k AS (SELECT *, row_number() OVER (PARTITION BY indicator_code, country_code, period ORDER BY promoted_at DESC, record_id DESC) AS rn FROM v_gold),
  a AS (SELECT indicator_code, country_code, period, count(*) FILTER (ch) AS chat, count(*) FILTER (NOT ch) AS api FROM (SELECT g.*, l_linenumber % 2 = 0 AS ch FROM lineitem JOIN v_gold g ON l_orderkey = record_id) GROUP BY ALL)
  SELECT md5('trail|' || k.indicator_code || '|' || k.country_code || '|' || k.period) AS trail_id, k.indicator_code, k.country_code, k.period, record_id, {V.rnd('value', 6)} AS value, source_code,
    coalesce(chat, 0) AS chatbot_sessions_count, coalesce(api, 0) AS api_calls_count
  FROM k LEFT JOIN a ON k.indicator_code = a.indicator_code AND k.country_code = a.country_code AND k.period = a.period WHERE rn = 1""")
def citation_trail(spark, folder):
    g = views.gold(spark, folder)
    return _flat_trails(PV.citation_trails(g, _accesses(spark, folder, g)))


@query("citation_trail_kept", sql=CATALOG["citation_trail"].sql)
def citation_trail_kept(spark, folder):
    """Trails kept over three runs, two of which are repeated: older figures first, then the published ones by halves.

    Each run brings a third of the look-ups.
    """
    g = views.gold(spark, folder)
    older = g.withColumn("promoted_at", F.timestamp_add("DAY", F.lit(-4000), F.col("promoted_at"))).withColumn("value", F.lit(0.0))
    part = F.pmod(F.col("record_id"), F.lit(2))
    batches = [older, g.where(part == 0), g.where(part == 1)]
    accesses = _accesses(spark, folder, g)
    store = PV.trail_store(spark, fresh_path(spark, "trails"))
    for run in (0, 1, 1, 2, 0):
        PV.update_trails(store, batches[run], accesses.where(F.col("l_linenumber") % 3 == run), run)
    return _flat_trails(PV.stored_trails(store, 3))


@query("extraction_traces", sql="""
  SELECT page_id AS trace_id, url AS source_url, substr(html, 1, 500) AS raw_excerpt, CAST(length(html) AS INT) AS source_chars, 'm' || CAST(page_id % 3 AS VARCHAR) AS model, (page_id % 100) / 100e0 AS confidence FROM pages""")
def extraction_traces(spark, folder):
    rows = table(spark, folder, "pages").select(
        F.col("page_id").alias("trace_id"), F.col("url").alias("source_url"), F.col("html").alias("raw_text"),
        F.concat(F.lit("m"), (F.col("page_id") % 3).cast("string")).alias("model"), (F.col("page_id") % 100 / F.lit(100.0)).alias("confidence"),
    )
    return PV.extraction_traces(rows)


@query("news_embedding_text", uses=["news"], sql="""
  SELECT news_id, 'Title: ' || title || chr(10) || 'Category: ' || source_name || chr(10) || 'Content: ' || substr(content, 1, 1000) AS text FROM v_news""")
def news_embedding_text(spark, folder):
    return views.news(spark, folder).select(
        "news_id", text.news_text(F.col("title"), F.col("source_name"), F.col("content")).alias("text")
    )
