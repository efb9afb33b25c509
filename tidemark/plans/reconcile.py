"""Conflict, revision and validation queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.numeric import rnd
from tidemark.operators import reconcile as R
from tidemark.plans import sqlviews as V
from tidemark.plans.catalog import query
from tidemark.sources import views
from tidemark.sources.tables import table

AS_OF = partial(views.clock, views.AS_OF_ORDERS)

_RESOLVED = f"""
  WITH k AS (SELECT indicator_code, country_code, period, count(*) AS n_candidates,
      {V.rnd('CASE WHEN avg(value) <> 0 THEN (max(value) - min(value)) / abs(avg(value)) * 100 ELSE 0 END', 6)} AS v,
      first(source_code ORDER BY reliability DESC, source_code) AS rs, first(value ORDER BY reliability DESC, source_code) AS rv,
      first(source_code ORDER BY rec DESC, source_code) AS bs, first(value ORDER BY rec DESC, source_code) AS bv
    FROM (SELECT *, {V.rnd(f"reliability * CAST(0.7 AS DOUBLE) + 30e0 / (date_diff('microsecond', crawled_at, {V.O}) / 1e6 / 3600 + 1)", 9)} AS rec FROM v_candidates)
    GROUP BY ALL),
  g AS (SELECT indicator_code AS gi, country_code AS gc, source_code AS ks, value AS kv FROM (
      SELECT *, row_number() OVER (PARTITION BY indicator_code, country_code ORDER BY period DESC, promoted_at DESC, record_id DESC) AS rn FROM v_gold) WHERE rn = 1),
  s AS (SELECT *, CASE WHEN n_candidates <= 1 OR v < 1 THEN 'ROUTINE' WHEN v <= 5 THEN 'MODERATE' ELSE 'MAJOR' END AS severity
    FROM k LEFT JOIN g ON indicator_code = gi AND country_code = gc),
  r AS (SELECT indicator_code, country_code, period, n_candidates, CASE WHEN n_candidates <= 1 THEN CAST(0 AS DOUBLE) ELSE v END AS variance_pct, severity,
    CASE severity WHEN 'ROUTINE' THEN rs WHEN 'MODERATE' THEN bs ELSE coalesce(ks, rs) END AS selected_source,
    CASE severity WHEN 'ROUTINE' THEN rv WHEN 'MODERATE' THEN bv ELSE coalesce(kv, rv) END AS selected_value,
    severity = 'MAJOR' AS requires_review FROM s)"""


@query("conflict_spread", uses=["candidates"], sql=f"""
  SELECT indicator_code, country_code, period, count(*) AS n_candidates,
    {V.rnd('CASE WHEN avg(value) <> 0 THEN (max(value) - min(value)) / abs(avg(value)) * 100 ELSE 0 END', 6)} AS variance_pct
  FROM v_candidates GROUP BY ALL""")
def conflict_spread(spark, folder):
    return R.conflict_spread(views.candidates(spark, folder))


def _resolved(spark, folder):
    return R.resolve_conflicts(views.candidates(spark, folder), views.gold(spark, folder), AS_OF())


@query("conflict_resolution", uses=["candidates"], sql=_RESOLVED + f"""
  SELECT indicator_code, country_code, period, n_candidates, variance_pct, severity, selected_source,
    {V.rnd('selected_value', 6)} AS selected_value, requires_review FROM r""")
def conflict_resolution(spark, folder):
    return _resolved(spark, folder).drop("rationale").withColumn("selected_value", rnd("selected_value", 6))


@query("recent_conflicts", uses=["candidates"], sql=_RESOLVED + f"""
  SELECT indicator_code, country_code, period, severity, selected_source, last AS resolved_at FROM r
  JOIN (SELECT indicator_code, country_code, period, max(crawled_at) AS last FROM v_candidates GROUP BY ALL) USING (indicator_code, country_code, period)
  WHERE last >= {V.O} - INTERVAL 7 DAY ORDER BY last DESC, indicator_code, country_code, period LIMIT 200""")
def recent_conflicts(spark, folder):
    last = views.candidates(spark, folder).groupBy(*R.KEY).agg(F.max("crawled_at").alias("resolved_at"))
    log = _resolved(spark, folder).join(last, R.KEY)
    return R.recent_conflicts(log, AS_OF()).select(*R.KEY, "severity", "selected_source", "resolved_at")


@query("source_selection_history", uses=["candidates"], sql=_RESOLVED + f"""
  SELECT indicator_code, country_code, period, selected_source, decided_at, candidates FROM r
  JOIN (SELECT indicator_code, country_code, period, max(crawled_at) AS decided_at,
      string_agg(source_code || ':' || CAST(CAST(reliability AS BIGINT) AS VARCHAR) || ':' ||
        CAST(CAST(floor(date_diff('second', crawled_at, {V.O}) / 3600) AS BIGINT) AS VARCHAR), ',' ORDER BY source_code) AS candidates
    FROM v_candidates GROUP BY ALL) USING (indicator_code, country_code, period)
  WHERE indicator_code = 'GDP_GROWTH' ORDER BY decided_at DESC, indicator_code, country_code, period LIMIT 50""")
def source_selection_history(spark, folder):
    log = R.selection_log(views.candidates(spark, folder), _resolved(spark, folder), AS_OF())
    entry = F.transform("candidates", lambda c: F.concat(
        c["source_code"], F.lit(":"), c["reliability"].cast("bigint").cast("string"), F.lit(":"),
        c["freshness_hours"].cast("string")))
    return R.selection_history(log, "GDP_GROWTH").select(
        *R.KEY, "selected_source", "decided_at", F.array_join(entry, ",").alias("candidates")
    )


_CURRENT = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY indicator_code, country_code, period
      ORDER BY promoted_at DESC, record_id DESC) AS rn FROM v_gold) WHERE rn = 1"""


@query("revision_events", uses=["candidates"], sql=f"""
  WITH c AS ({_CURRENT}), j AS (SELECT i.*, c.record_id AS gold_record_id, c.value AS old_value,
      CASE WHEN c.value = 0 THEN 0 ELSE (i.value - c.value) / abs(c.value) * 100 END AS pct
    FROM v_candidates i JOIN c ON i.indicator_code = c.indicator_code AND i.country_code = c.country_code AND i.period = c.period
    WHERE i.value <> c.value)
  SELECT indicator_code, country_code, period, source_code, gold_record_id, {V.rnd('old_value', 6)} AS old_value,
    {V.rnd('value', 6)} AS new_value, {V.rnd('pct', 4)} AS revision_pct, abs({V.rnd('pct', 6)}) > 10 AS is_significant FROM j""")
def revision_events(spark, folder):
    incoming = views.candidates(spark, folder).withColumn("revised_at", AS_OF())
    out = R.detect_revisions(views.gold(spark, folder), incoming)
    return out.select(
        *R.KEY, "source_code", "gold_record_id", rnd("old_value", 6).alias("old_value"),
        rnd("new_value", 6).alias("new_value"), rnd("revision_pct", 4).alias("revision_pct"), "is_significant",
    )


_CHAIN = """SELECT *, value AS new_value, promoted_at AS revised_at FROM (SELECT *, lag(value) OVER (
      PARTITION BY indicator_code, country_code, period ORDER BY promoted_at, record_id) AS old_value FROM v_gold)
    WHERE old_value IS NOT NULL AND old_value <> value"""


@query("revision_history", uses=["gold"], sql=f"""
  WITH l AS ({_CHAIN})
  SELECT country_code, period, record_id, {V.rnd('old_value', 6)} AS old_value, {V.rnd('new_value', 6)} AS new_value,
    {V.rnd('(new_value - old_value) / abs(old_value) * 100', 4)} AS revision_pct, revised_at
  FROM l WHERE indicator_code = 'GOVT_DEBT_PCT_GDP' ORDER BY revised_at DESC, record_id LIMIT 100""")
def revision_history(spark, folder):
    log = R.revision_chain(views.gold(spark, folder))
    return R.revision_history(log, "GOVT_DEBT_PCT_GDP").select(
        "country_code", "period", "record_id", rnd("old_value", 6).alias("old_value"),
        rnd("new_value", 6).alias("new_value"), rnd("revision_pct", 4).alias("revision_pct"), "revised_at",
    )


@query("value_as_of", uses=["gold"], sql=f"""
  WITH l AS ({_CHAIN}), c AS ({_CURRENT}),
  f AS (SELECT indicator_code, country_code, period, first(old_value ORDER BY revised_at, record_id) AS old_value
    FROM l WHERE revised_at > TIMESTAMP '1998-07-01' GROUP BY ALL)
  SELECT c.indicator_code, c.country_code, c.period, {V.rnd('coalesce(f.old_value, c.value)', 6)} AS value, f.old_value IS NOT NULL AS was_revised
  FROM c LEFT JOIN f ON c.indicator_code = f.indicator_code AND c.country_code = f.country_code AND c.period = f.period""")
def value_as_of(spark, folder):
    g = views.gold(spark, folder)
    out = R.value_as_of(g, R.revision_chain(g), views.clock("1998-07-01 00:00:00"))
    return out.withColumn("value", rnd("value", 6))


@query("values_as_of", uses=["gold"], sql=f"""
  WITH l AS ({_CHAIN}), c AS ({_CURRENT}),
  q AS (SELECT record_id AS request_id, indicator_code, country_code, period, crawled_at AS as_of FROM v_gold),
  f AS (SELECT request_id, first(old_value ORDER BY revised_at, l.record_id) AS old_value, count(*) AS n FROM q JOIN l
    ON q.indicator_code = l.indicator_code AND q.country_code = l.country_code AND q.period = l.period AND revised_at > as_of GROUP BY ALL)
  SELECT q.request_id, q.indicator_code, q.country_code, q.period, as_of, {V.rnd('CASE WHEN n > 0 THEN old_value ELSE c.value END', 6)} AS value, coalesce(n > 0, false) AS was_revised
  FROM q JOIN c ON q.indicator_code = c.indicator_code AND q.country_code = c.country_code AND q.period = c.period LEFT JOIN f ON q.request_id = f.request_id""")
def values_as_of(spark, folder):
    """What every record's key was known to be at the time the record was crawled."""
    g = views.gold(spark, folder)
    requests = g.select(F.col("record_id").alias("request_id"), *R.KEY, F.col("crawled_at").alias("as_of"))
    return R.values_as_of(requests, g, R.revision_chain(g)).withColumn("value", rnd("value", 6))


_VR = K.VALIDATOR_RANGES


@query("validator_report", uses=["gold"], sql=f"""
  WITH c AS ({_CURRENT}),
  p AS (SELECT *, row_number() OVER (PARTITION BY indicator_code, country_code ORDER BY period DESC) AS pr FROM c),
  q AS (SELECT indicator_code AS qi, country_code AS qc, max(CASE WHEN pr = 1 THEN period END) AS p1, max(CASE WHEN pr = 1 THEN value END) AS v1,
      max(CASE WHEN pr = 2 THEN value END) AS v2 FROM p WHERE pr <= 2 GROUP BY ALL),
  j AS (SELECT *, CASE WHEN p1 <> period THEN v1 ELSE v2 END AS prev,
      {V.case_map('indicator_code', {k: v[0] for k, v in _VR.items()})} AS lo, {V.case_map('indicator_code', {k: v[1] for k, v in _VR.items()})} AS hi,
      {V.case_map('indicator_code', K.VALIDATOR_MAX_CHANGE_PCT)} AS mx, {V.case_map('indicator_code', K.VALIDATOR_REFRESH_DAYS, '90')} AS days,
      date_sub('day', crawled_at, {V.O}) AS age
    FROM v_gold LEFT JOIN q ON indicator_code = qi AND country_code = qc),
  m AS (SELECT *, CASE WHEN prev <> 0 THEN {V.rnd('abs((value - prev) / abs(prev)) * 100', 6)} END AS change FROM j),
  e AS (SELECT record_id, length(country_code) <> 3 AS e1, value < lo OR value > hi AS e2, coalesce(change > mx, false) AS e3, age > 2 * days AS w FROM m),
  n AS (SELECT *, CAST(e1 AS INT) + CAST(e2 AS INT) + CAST(e3 AS INT) AS n_errors, CAST(w AS INT) AS n_warnings FROM e)
  SELECT record_id, n_errors, n_warnings, greatest(0, 100 - 20e0 * n_errors - 5e0 * n_warnings) AS score, n_errors = 0 AND n_warnings <= 6 AS passed,
    concat_ws(',', CASE WHEN e1 THEN 'SCHEMA' END, CASE WHEN e2 THEN 'RANGE' END, CASE WHEN e3 THEN 'CONSISTENCY' END, CASE WHEN w THEN 'FRESHNESS' END) AS layers FROM n""")
def validator_report(spark, folder):
    g = views.gold(spark, folder)
    out = R.validate(g, g, AS_OF())
    return out.select(
        "record_id", "n_errors", "n_warnings", "score", "passed",
        F.array_join(F.transform("failures", lambda f: f["layer"]), ",").alias("layers"),
    )
