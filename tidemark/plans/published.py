"""Queries over published records."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.numeric import rnd
from tidemark.operators import backfill
from tidemark.operators import medallion as M
from tidemark.operators import published as P
from tidemark.plans import sqlviews as V
from tidemark.plans.catalog import query
from tidemark.plans.medallion import AS_OF, silver
from tidemark.session import fresh_path
from tidemark.sources import views
from tidemark.sources.tables import indicator_dim, source_dim, table

NATIONS = ["NATION_1", "NATION_6", "NATION_11", "NATION_16", "NATION_21"]
_NATIONS = V.in_list(NATIONS)


@query("gold_scan", uses=["gold"], sql=f"""
  SELECT record_id, indicator_code, country_code, period, {V.rnd('value', 6)} AS value, is_forecast FROM v_gold
  WHERE (tenant_id IS NULL OR tenant_id = 2) AND indicator_code = 'GDP_GROWTH' AND period >= '1997' AND period < '2001'
    AND NOT is_forecast ORDER BY period, record_id LIMIT 500""")
def gold_scan(spark, folder):
    return P.scan(views.gold(spark, folder), 2, "gdp_growth", None, 1997, 2000, True).select(
        "record_id", "indicator_code", "country_code", "period", rnd("value", 6).alias("value"), "is_forecast"
    )


@query("timeseries", uses=["gold"], sql=f"""
  SELECT record_id, period, {V.rnd('value', 6)} AS value FROM v_gold
  WHERE tenant_id IS NULL OR tenant_id = 1 QUALIFY indicator_code = 'CPI_INFLATION' AND country_code = 'NATION_3' AND NOT is_forecast
  ORDER BY period, record_id LIMIT 50""".replace("QUALIFY", "AND").replace("tenant_id IS NULL OR tenant_id = 1", "(tenant_id IS NULL OR tenant_id = 1)"))
def timeseries(spark, folder):
    return P.timeseries(views.gold(spark, folder), 1, "CPI_INFLATION", "NATION_3").select(
        "record_id", "period", rnd("value", 6).alias("value")
    )


@query("gold_browse", uses=["gold"], sql="""
  SELECT record_id, indicator_code, country_code, source_code, period FROM v_gold WHERE source_code = 'MACHINERY'
  ORDER BY period DESC, record_id LIMIT 500""")
def gold_browse(spark, folder):
    return P.browse(views.gold(spark, folder), source="MACHINERY").select(
        "record_id", "indicator_code", "country_code", "source_code", "period"
    )


@query("compare_latest", uses=["gold"], sql=f"""
  SELECT country_code, record_id, period, {V.rnd('value', 6)} AS value FROM (
    SELECT *, row_number() OVER (PARTITION BY country_code ORDER BY period DESC, record_id) AS rn FROM v_gold
    WHERE (tenant_id IS NULL OR tenant_id = 1) AND indicator_code = 'GDP_GROWTH' AND country_code IN {_NATIONS} AND NOT is_forecast)
  WHERE rn = 1""")
def compare_latest(spark, folder):
    return P.compare(views.gold(spark, folder), 1, "GDP_GROWTH", NATIONS).select(
        "country_code", "record_id", "period", rnd("value", 6).alias("value")
    )


@query("compare_period", uses=["gold"], sql=f"""
  SELECT country_code, record_id, {V.rnd('value', 6)} AS value FROM v_gold WHERE (tenant_id IS NULL OR tenant_id = 1)
    AND indicator_code = 'UNEMPLOYMENT_RATE' AND country_code IN {_NATIONS} AND NOT is_forecast AND period = '1999'""")
def compare_period(spark, folder):
    return P.compare(views.gold(spark, folder), 1, "UNEMPLOYMENT_RATE", NATIONS, "1999").select(
        "country_code", "record_id", rnd("value", 6).alias("value")
    )


@query("authoritative_records", uses=["gold"], sql=f"""
  SELECT indicator_code, country_code, period, record_id, {V.rnd('value', 6)} AS value, dq_score FROM (
    SELECT *, row_number() OVER (PARTITION BY indicator_code, country_code, period ORDER BY dq_score DESC, promoted_at DESC, record_id) AS rn
    FROM v_gold WHERE period BETWEEN '1995' AND '2024') WHERE rn = 1""")
def authoritative_records(spark, folder):
    return P.authoritative(views.gold(spark, folder), 1995, 2024).select(
        *P.KEY, "record_id", rnd("value", 6).alias("value"), "dq_score"
    )


YEARS = list(range(1995, 2002))


@query("explorer_pivot", uses=["gold"], sql="""
  SELECT country_code, """ + ", ".join(
    f"{V.rnd(f'avg(value) FILTER (period = {chr(39)}{y}{chr(39)})', 4)} AS y{y}" for y in YEARS) + """
  FROM v_gold WHERE indicator_code = 'CPI_INFLATION' GROUP BY country_code""")
def explorer_pivot(spark, folder):
    g = views.gold(spark, folder).filter(F.col("indicator_code") == "CPI_INFLATION")
    return P.annual_pivot(g, YEARS).select(
        "country_code", *[rnd(F.col(f"`{y}`"), 4).alias(f"y{y}") for y in YEARS]
    )


@query("peer_matrix", uses=["gold"], sql=f"""
  WITH n AS (SELECT *, row_number() OVER (PARTITION BY indicator_code, period, country_code ORDER BY promoted_at DESC, record_id DESC) AS rn
    FROM v_gold WHERE country_code IN {_NATIONS})
  SELECT indicator_code, period, """ + ", ".join(
    f"{V.rnd(f'max(value) FILTER (country_code = {V.q(c)})', 6)} AS {c.lower()}" for c in NATIONS) + """
  FROM n WHERE rn = 1 GROUP BY ALL""")
def peer_matrix(spark, folder):
    out = P.period_matrix(views.gold(spark, folder), NATIONS, ["indicator_code", "period"])
    return out.select("indicator_code", "period", *[rnd(c, 6).alias(c.lower()) for c in NATIONS])


@query("explorer_page", uses=["gold"], sql=f"""
  SELECT record_id, indicator_code, country_code, period, {V.rnd('value', 6)} AS value FROM v_gold
  WHERE NOT is_forecast AND (lower(indicator_code) LIKE '%gdp%' OR lower(country_code) LIKE '%gdp%' OR lower(period) LIKE '%gdp%')
  ORDER BY coalesce(value, 0) DESC, record_id LIMIT 300""")
def explorer_page(spark, folder):
    return P.explorer_page(views.gold(spark, folder), " GDP ", "actual", "value", True).select(
        "record_id", *P.KEY, rnd("value", 6).alias("value")
    )


@query("overview_stats", uses=["gold", "silver"], sql=f"""
  SELECT (SELECT count(*) FROM v_gold WHERE tenant_id IS NULL OR tenant_id = 1) AS gold_records,
    (SELECT count(*) FROM v_silver WHERE tenant_id IS NULL OR tenant_id = 1) AS total_ingested,
    (SELECT count(*) FROM v_silver WHERE dq_status = 'REVIEW' AND tenant_id = 1) AS pending_review,
    CAST({len(K.SOURCES)} AS BIGINT) AS active_sources,
    (SELECT {V.rnd('avg(dq_score)', 1)} FROM v_gold WHERE tenant_id IS NULL OR tenant_id = 1) AS avg_dq_score""")
def overview_stats(spark, folder):
    queue = M.review_items(silver(spark, folder), AS_OF())
    return P.overview(views.gold(spark, folder), views.bronze(spark, folder), queue, source_dim(spark), 1)


@query("catalogue_topics", sql=f"""
  WITH c AS (SELECT * FROM (VALUES {', '.join(f"({i}, {V.q(k)}, {V.q(v[0].upper())})" for i, (k, v) in enumerate(K.INDICATORS.items()))}) t(pos, code, name)),
  t AS (SELECT p_partkey AS topic_id, p_name || ' ' || CASE p_size % 4 WHEN 0 THEN 'inflation' WHEN 1 THEN 'debt' WHEN 2 THEN 'trade' ELSE 'rate' END AS topic FROM part),
  w AS (SELECT topic_id, unnest(string_split(upper(topic), ' ')) AS w FROM t),
  m AS (SELECT topic_id, pos, code FROM w JOIN c ON contains(name, w) OR contains(code, w) GROUP BY ALL)
  SELECT t.topic_id, coalesce((SELECT string_agg(code, ',' ORDER BY pos) FROM m WHERE m.topic_id = t.topic_id), 'GDP_GROWTH,CPI_INFLATION') AS codes FROM t""")
def catalogue_topics(spark, folder):
    words = F.element_at(F.array(*[F.lit(w) for w in ("inflation", "debt", "trade", "rate")]), F.col("p_size") % 4 + 1)
    topics = table(spark, folder, "part").select(
        F.col("p_partkey").alias("topic_id"), F.concat("p_name", F.lit(" "), words).alias("topic")
    )
    found = P.keyword_codes(indicator_dim(spark), topics)
    return found.select("topic_id", F.array_join("codes", ",").alias("codes"))


@query("research_context", uses=["gold", "news"], sql=f"""
  SELECT * FROM (SELECT 'record' AS kind, record_id AS item_id, '- ' || indicator_code || ' (' || country_code || ', ' || period || '): ' ||
      {V.plain('value')} || ' ' || standard_unit AS line FROM v_gold
    WHERE (tenant_id IS NULL OR tenant_id = 1) AND indicator_code IN ('GDP_GROWTH', 'CPI_INFLATION') ORDER BY period DESC, record_id LIMIT 20)
  UNION ALL SELECT * FROM (SELECT 'news', news_id, '- ' || title || ' (' || source_name || ')' FROM v_news
    WHERE tenant_id IS NULL OR tenant_id = 1 ORDER BY published_at DESC NULLS LAST, news_id LIMIT 5)""")
def research_context(spark, folder):
    return P.research_context(
        views.gold(spark, folder), views.news(spark, folder), ["GDP_GROWTH", "CPI_INFLATION"], 1
    )


def _summary_sql(source: str, group: str) -> str:
    return f"""
  WITH t AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY period DESC, record_id) AS rn FROM {source}
      WHERE (tenant_id IS NULL OR tenant_id = 1) AND period >= '1998'),
  l AS (SELECT *, '- ' || indicator_code || ': ' || {V.plain('value')} || ' ' || standard_unit || ' (' || country_code || ', ' || period || ')' ||
      CASE WHEN is_forecast THEN ' [FORECAST]' ELSE '' END || ' [Source: ' || source_code || ']' AS line FROM t WHERE rn <= 50)
  SELECT {group}, string_agg(line, chr(10) ORDER BY indicator_code, period, record_id) AS data_block,
    string_agg(CAST(record_id AS VARCHAR), ',' ORDER BY indicator_code, period, record_id) AS record_ids, count(*) AS n_records
  FROM l GROUP BY {group}"""


_SECTORS = ", ".join(f"({V.q(s)}, {V.q(c)})" for s, codes in K.SECTOR_INDICATORS.items() for c in codes)


@query("summary_block", uses=["gold"], sql=_summary_sql("v_gold", "country_code"))
def summary_block(spark, folder):
    return P.summary_lines(views.gold(spark, folder), 1, "country_code", 1998)


@query("summary_indicator", uses=["gold"], sql=_summary_sql("v_gold", "indicator_code"))
def summary_indicator(spark, folder):
    return P.summary_lines(views.gold(spark, folder), 1, "indicator_code", 1998)


@query("summary_sector", uses=["gold"], sql=_summary_sql(f"(SELECT * FROM v_gold JOIN (VALUES {_SECTORS}) x(sector, ic) ON indicator_code = ic)", "sector"))
def summary_sector(spark, folder):
    return P.summary_lines(P.by_sector(views.gold(spark, folder)), 1, "sector", 1998)


@query("embedding_backlog", uses=["gold"], sql=f"""
  SELECT record_id, 'Indicator: ' || indicator_code || ' | Country: ' || country_code || ' | Period: ' || period || ' | Value: ' ||
    {V.plain('value')} || ' ' || standard_unit || ' | Source: ' || source_code || CASE WHEN is_forecast THEN ' | Type: forecast/projection' ELSE '' END AS text
  FROM v_gold WHERE tenant_id = 1 AND record_id NOT IN (SELECT vec_id FROM embeddings)""")
def embedding_backlog(spark, folder):
    have = table(spark, folder, "embeddings").select(F.col("vec_id").alias("record_id"))
    return P.embedding_backlog(views.gold(spark, folder), have, 1)


def _model(texts, broken=()):
    """Stands in for an embedding service: lengths of the text and of its longest word."""
    if any(f"| Country: {c} |" in t for t in texts[:1] for c in broken):
        raise ConnectionError("service unavailable")
    return [[len(t), max(map(len, t.split(" ")))] for t in texts]


@query("embedding_backfill", uses=["gold"], sql=f"""
  WITH t AS (SELECT record_id, country_code, 'Indicator: ' || indicator_code || ' | Country: ' || country_code || ' | Period: ' || period || ' | Value: ' ||
      {V.plain('value')} || ' ' || standard_unit || ' | Source: ' || source_code || CASE WHEN is_forecast THEN ' | Type: forecast/projection' ELSE '' END AS text
    FROM v_gold WHERE tenant_id = 1 AND record_id NOT IN (SELECT vec_id FROM embeddings)),
  b AS (SELECT *, (row_number() OVER (ORDER BY record_id) - 1) // 200 AS batch FROM t)
  SELECT batch, record_id, CAST(length(text) AS BIGINT) AS text_chars,
    CASE WHEN arg_min(country_code, record_id) OVER (PARTITION BY batch) IN {_NATIONS} THEN 1 ELSE 0 END AS run FROM b""")
def embedding_backfill(spark, folder):
    """Batches of 200; some fail in the first run and only those are done in the second."""
    path = fresh_path(spark, "backfill")
    backfill.plan(embedding_backlog(spark, folder), path)
    backfill.run_pending(spark, path, 0, partial(_model, broken=NATIONS))
    backfill.run_pending(spark, path, 1, _model)
    return backfill.vectors(spark, path).select("batch", "record_id", F.col("embedding")[0].cast("bigint").alias("text_chars"), "run")


@query("gold_point_lookup", uses=["gold"], sql=f"""
  SELECT record_id, indicator_code, country_code, period, {V.rnd('value', 6)} AS value FROM v_gold WHERE record_id = 42""")
def gold_point_lookup(spark, folder):
    return views.gold(spark, folder).filter(F.col("record_id") == 42).select("record_id", *P.KEY, rnd("value", 6).alias("value"))
