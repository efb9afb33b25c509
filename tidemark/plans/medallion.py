"""Ingest and routing queries over raw observations."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import parsing, periods, scoring
from tidemark.functions.numeric import plain, rnd
from tidemark.operators import medallion as M
from tidemark.plans import sqlviews as V
from tidemark.plans.catalog import query
from tidemark.session import fresh_path, materialise
from tidemark.sources import sinks, views
from tidemark.sources.tables import source_dim

AS_OF = partial(views.clock, views.AS_OF_EVENTS)


def silver(spark, folder):
    return M.to_silver(views.bronze(spark, folder), AS_OF())


@query("medallion_counts", uses=["silver"], sql=f"""
  SELECT source_code, dq_status, count(*) AS n,
    {V.rnd('CAST(sum(CAST(dq_score * 100 AS BIGINT)) AS BIGINT) / count(*) / 100', 4)} AS avg_dq
  FROM v_silver GROUP BY ALL""")
def medallion_counts(spark, folder):
    return M.status_counts(silver(spark, folder)).withColumn("avg_dq", rnd("avg_dq", 4))


@query("parse_values", uses=["parsed"], sql=f"""
  SELECT record_id, raw_value, standard_unit, {V.rnd('value', 6)} AS value, is_forecast,
    CASE WHEN value IS NOT NULL AND coalesce(raw_unit, '') <> '' AND raw_unit IS DISTINCT FROM standard_unit
         THEN 'unit_converted:' || raw_unit || '->' || coalesce(standard_unit, '') END AS normalisation
  FROM v_parsed""")
def parse_values(spark, folder):
    return parsing.with_value(views.bronze(spark, folder)).select(
        "record_id", "raw_value", "standard_unit", rnd("value", 6).alias("value"),
        parsing.is_forecast("raw_value").alias("is_forecast"),
        parsing.conversion_note(F.col("value"), F.col("raw_unit"), F.col("standard_unit")).alias("normalisation"),
    )


@query("dq_scores", uses=["silver"], sql="""
  SELECT record_id, accuracy, completeness, timeliness, consistency, dq_score, reasons FROM v_silver""")
def dq_scores(spark, folder):
    return silver(spark, folder).select(
        "record_id", "accuracy", "completeness", "timeliness", "consistency", "dq_score",
        F.array_join("failure_reasons", ";").alias("reasons"),
    )


@query("dq_routing", uses=["silver"], sql="""
  SELECT record_id, dq_status,
    CASE WHEN dq_score / 100 >= CAST(0.85 AS DOUBLE) THEN 'AUTO_ACCEPT' WHEN dq_score / 100 >= CAST(0.7 AS DOUBLE) THEN 'QUEUE_REVIEW' ELSE 'REJECT' END AS gate,
    CASE WHEN dq_score > 90 THEN 'AUTO_APPROVED' WHEN dq_score >= 70 THEN 'PENDING_REVIEW' ELSE 'REJECTED' END AS oversight
  FROM v_silver""")
def dq_routing(spark, folder):
    score = F.col("dq_score")
    return silver(spark, folder).select(
        "record_id", "dq_status",
        scoring.confidence_decision(score / 100).alias("gate"),
        scoring.oversight_decision(score).alias("oversight"),
    )


@query("ingest_outcomes", uses=["silver"], sql="""
  SELECT count(*) FILTER (dq_status = 'AUTO_PROMOTED') AS promoted, count(*) FILTER (dq_status = 'REVIEW') AS queued,
    count(*) FILTER (dq_status = 'REJECTED') AS rejected FROM v_silver""")
def ingest_outcomes(spark, folder):
    return M.outcome_counts(silver(spark, folder))


@query("raw_validation_errors", uses=["bronze"], sql=f"""
  SELECT record_id, concat_ws(';',
      CASE WHEN NOT coalesce(regexp_matches(country_code, '{K.ISO3}'), false) THEN 'invalid_country_code: ' || coalesce(country_code, 'None') END,
      CASE WHEN NOT coalesce(regexp_matches(period, '{K.PERIOD}'), false) THEN 'invalid_period: ' || coalesce(period, 'None') END,
      CASE WHEN NOT coalesce(indicator_code IN {V.in_list(K.RAW_RECORD_INDICATORS)}, false) THEN 'unknown_indicator: ' || coalesce(indicator_code, 'None') END,
      CASE WHEN raw_value IS NULL OR raw_value IN {V.in_list(K.MISSING_RAW_VALUES)} THEN 'missing_raw_value' END) AS errors
  FROM v_bronze""")
def raw_validation_errors(spark, folder):
    c = F.col
    errors = parsing.record_errors(c("country_code"), c("period"), c("indicator_code"), c("raw_value"))
    return views.bronze(spark, folder).select("record_id", F.array_join(errors, ";").alias("errors"))


_SEEN = """
  seen AS (SELECT a.record_id, count(b.record_id) AS n_seen, max_by(b.value, (b.crawled_at, b.record_id)) FILTER (b.record_id IS NOT NULL) AS prev
    FROM p a LEFT JOIN p b ON NOT b.is_forecast AND (b.tenant_id IS NULL OR b.tenant_id = a.tenant_id)
      AND a.indicator_code IS NOT DISTINCT FROM b.indicator_code AND a.country_code IS NOT DISTINCT FROM b.country_code AND a.period IS NOT DISTINCT FROM b.period
      AND (b.crawled_at < a.crawled_at OR b.crawled_at = a.crawled_at AND b.record_id < a.record_id) GROUP BY a.record_id)"""


@query("gold_promotion_revisions", uses=["silver"], sql=f"""
  WITH p AS (SELECT * FROM v_silver WHERE dq_status = 'AUTO_PROMOTED'),{_SEEN}
  SELECT record_id, tenant_id, indicator_code, country_code, period, source_code,
    CASE source_code {' '.join(f"WHEN {V.q(s[0])} THEN {V.q(s[1])}" for s in K.SOURCES)} ELSE source_code END AS source_name,
    {V.rnd('value', 6)} AS value, n_seen > 0 AS revision_flag, {V.rnd('value - prev', 6)} AS revision_delta FROM p JOIN seen USING (record_id)""")
def gold_promotion_revisions(spark, folder):
    ready = silver(spark, folder).filter(F.col("dq_status") == "AUTO_PROMOTED").withColumn(
        "promoted_at", F.col("crawled_at")
    ).select("record_id", "tenant_id", "indicator_code", "country_code", "period", "source_code", "value", "is_forecast", "promoted_at")
    named = M.with_sources(M.flag_revisions(ready), source_dim(spark))
    return named.select(
        "record_id", "tenant_id", "indicator_code", "country_code", "period", "source_code", "source_name",
        rnd("value", 6).alias("value"), "revision_flag", rnd("revision_delta", 6).alias("revision_delta"),
    )


@query("review_queue_items", uses=["silver"], sql=f"""
  SELECT md5('queue|' || CAST(record_id AS VARCHAR)) AS queue_id, record_id AS bronze_id, tenant_id, indicator_code, country_code, period,
    coalesce({V.plain('value')}, 'N/A') AS extracted_value, dq_score, reasons, 'PENDING' AS status,
    {V.E} + INTERVAL 4 HOUR AS sla_deadline
  FROM v_silver WHERE dq_status = 'REVIEW'""")
def review_queue_items(spark, folder):
    return M.review_items(silver(spark, folder), AS_OF()).select(
        "queue_id", "bronze_id", "tenant_id", "indicator_code", "country_code", "period", "extracted_value",
        "dq_score", F.array_join("failure_reasons", ";").alias("reasons"), "status", "sla_deadline",
    )


def silver_once(spark, folder):
    """Silver as a table: scored once, read wherever it is needed."""
    return materialise(spark, silver(spark, folder), "silver")


def _queue(scored):
    """Review queue as it stood: due from the crawl time on."""
    return M.review_items(scored.withColumn("_at", F.col("crawled_at")), F.col("_at"))


def _decisions(scored):
    """One analyst decision per queued record, from the events the records came from."""
    kind = F.col("record_id") % 4
    return scored.filter((F.col("dq_status") == "REVIEW") & (kind != 3)).select(
        F.col("record_id").alias("bronze_id"),
        F.when(kind == 2, "reject").otherwise("approve").alias("action"),
        F.when(kind == 1, (F.col("record_id") % 1000) / F.lit(10.0)).alias("adjusted_value"),
        F.concat(F.lit("analyst"), (F.col("record_id") % 3).cast("string")).alias("reviewer"),
    )


def reviewed(scored):
    """The queue after all decisions."""
    return M.apply_decisions(_queue(scored), _decisions(scored), "bronze_id")


_APPLIED = f"""
  WITH qd AS (SELECT *, record_id % 4 AS kind, crawled_at + INTERVAL 4 HOUR AS due FROM v_silver WHERE dq_status = 'REVIEW'),
  done AS (SELECT *, CASE kind WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'ADJUSTED' WHEN 2 THEN 'REJECTED' ELSE 'PENDING' END AS status,
     CASE WHEN kind = 1 THEN (record_id % 1000) / 10e0 ELSE value END AS final FROM qd)"""


@query("review_decisions", uses=["silver"], sql=_APPLIED + f"""
  SELECT record_id AS bronze_id, status, {V.rnd('final', 6)} AS value,
    CASE WHEN kind <> 3 THEN 'analyst' || CAST(record_id % 3 AS VARCHAR) END AS reviewed_by,
    status IN ('APPROVED', 'ADJUSTED') AS to_gold FROM done""")
def review_decisions(spark, folder):
    return reviewed(silver_once(spark, folder)).select(
        "bronze_id", "status", rnd("value", 6).alias("value"), "reviewed_by",
        F.col("status").isin("APPROVED", "ADJUSTED").alias("to_gold"),
    )


@query("review_stats", uses=["silver"], sql=_APPLIED + f"""
  SELECT count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status IN ('APPROVED', 'ADJUSTED')) AS approved,
    count(*) FILTER (status = 'REJECTED') AS rejected, count(*) FILTER (status = 'PENDING' AND due < {V.E}) AS sla_breached FROM done""")
def review_stats(spark, folder):
    return M.review_stats(reviewed(silver_once(spark, folder)), AS_OF())


@query("review_promotion", uses=["silver"], sql=_APPLIED + f""",
  p AS (SELECT record_id, tenant_id, indicator_code, country_code, period, source_code, value, is_forecast, crawled_at, 'auto' AS approved_by FROM v_silver WHERE dq_status = 'AUTO_PROMOTED'
    UNION ALL SELECT record_id, tenant_id, indicator_code, country_code, period, source_code, final, is_forecast, due, 'analyst' || CAST(record_id % 3 AS VARCHAR)
    FROM done WHERE status IN ('APPROVED', 'ADJUSTED')),{_SEEN}
  SELECT record_id, tenant_id, indicator_code, country_code, period, approved_by, {V.rnd('value', 6)} AS value, n_seen > 0 AS revision_flag,
    {V.rnd('value - prev', 6)} AS revision_delta FROM p JOIN seen USING (record_id)""")
def review_promotion(spark, folder):
    """Approved and adjusted reviews join the promoted rows in Gold, at the time of the decision."""
    scored = silver_once(spark, folder).withColumn("promoted_at", F.col("crawled_at"))
    done = reviewed(scored).withColumn("decided_at", F.col("sla_deadline"))
    return M.flag_revisions(M.promoted_and_approved(scored, done)).select(
        "record_id", "tenant_id", "indicator_code", "country_code", "period", "approved_by",
        rnd("value", 6).alias("value"), "revision_flag", rnd("revision_delta", 6).alias("revision_delta"),
    )


@query("review_queue_page", uses=["silver"], sql=f"""
  SELECT record_id AS bronze_id, dq_score, crawled_at + INTERVAL 4 HOUR AS sla_deadline, crawled_at + INTERVAL 4 HOUR < {V.E} AS sla_breached
  FROM v_silver WHERE dq_status = 'REVIEW' AND tenant_id = 1 ORDER BY 3, 1 LIMIT 50""")
def review_queue_page(spark, folder):
    return M.review_page(_queue(silver(spark, folder)), AS_OF(), tenant=1).select(
        "bronze_id", "dq_score", "sla_deadline", "sla_breached"
    )


@query("incremental_unprocessed", uses=["bronze"], sql=f"""
  SELECT record_id, source_code, crawled_at FROM v_bronze b
  WHERE NOT EXISTS (SELECT 1 FROM v_bronze s WHERE s.record_id = b.record_id AND s.crawled_at < {V.E} - INTERVAL 30 DAY)""")
def incremental_unprocessed(spark, folder):
    b = views.bronze(spark, folder)
    done = b.filter(F.col("crawled_at") < F.timestamp_add("DAY", F.lit(-30), AS_OF())).select(
        F.col("record_id").alias("bronze_id")
    )
    return M.unprocessed(b, done).select("record_id", "source_code", "crawled_at")


@query("promotion_backlog", uses=["silver"], sql="""
  SELECT record_id, md5('silver|' || CAST(record_id AS VARCHAR)) AS silver_id, dq_score FROM v_silver
  WHERE dq_status = 'AUTO_PROMOTED' AND record_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def promotion_backlog(spark, folder):
    s = silver(spark, folder).withColumn("silver_id", M.silver_id(F.col("record_id")))
    published = views.table(spark, folder, "orders").filter(F.col("o_orderstatus") == "F").select(
        M.silver_id(F.col("o_orderkey")).alias("silver_id")
    )
    return M.promotion_backlog(s, published).select("record_id", "silver_id", "dq_score")


@query("unit_repair", uses=["gold"], sql=f"""
  SELECT standard_unit, count(*) AS n, count(*) FILTER (standard_unit = 'USD_BN' AND cents * 1e6 >= 1e9) AS fixed,
    {V.rnd("max(CASE WHEN standard_unit = 'USD_BN' AND cents * 1e6 >= 1e9 THEN cents * 1e6 / 1e9 ELSE cents * 1e6 END)", 4)} AS max_value
  FROM v_gold GROUP BY ALL""")
def unit_repair(spark, folder):
    """Amounts that reached Gold in base units are scaled back."""
    raw = views.gold(spark, folder).withColumn("value", F.col("cents") * F.lit(1e6))
    return M.repair_units(raw).groupBy("standard_unit").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("fixed").alias("fixed"), rnd(F.max("value"), 4).alias("max_value")
    )


@query("period_dates", uses=["bronze"], sql="""
  WITH p AS (SELECT record_id, period, TRY_CAST(regexp_extract(period, '(\\d{4})', 1) AS INT) AS year, regexp_extract(period, '^\\d{4}-Q([1-4])$', 1) AS q FROM v_bronze)
  SELECT record_id, period, year,
    TRY_CAST(CASE WHEN length(period) = 4 THEN period || '-01-01' WHEN q <> '' THEN substr(period, 1, 4) || '-' || lpad(CAST(CAST(q AS INT) * 3 - 2 AS VARCHAR), 2, '0') || '-01'
      WHEN length(period) = 7 THEN period || '-01' ELSE period END AS DATE) AS start_date,
    CASE WHEN length(period) = 4 THEN period || '-12-31' WHEN q <> '' THEN substr(period, 1, 4) || '-' || lpad(CAST(CAST(q AS INT) * 3 AS VARCHAR), 2, '0') || '-28' ELSE substr(period, 1, 10) END AS end_key FROM p""")
def period_dates(spark, folder):
    period = F.col("period")
    return views.bronze(spark, folder).select(
        "record_id", "period", scoring.period_year(period).alias("year"),
        periods.start_date(period).alias("start_date"), periods.end_key(period).alias("end_key"),
    )


@query("silver_layers", uses=["silver"], sql="""
  SELECT dq_status, count(*) AS n, min(record_id) AS first_id, max(record_id) AS last_id FROM v_silver GROUP BY ALL""")
def silver_layers(spark, folder):
    """Scored rows written once and read back route by route."""
    routes = sinks.write_routed(spark, silver(spark, folder), fresh_path(spark, "silver-layers"))
    out = None
    for status, rows in routes.items():
        one = rows.groupBy("dq_status").agg(
            F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id"))
        out = one if out is None else out.unionByName(one)
    return out
