"""Forecast and anomaly queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.numeric import rnd
from tidemark.operators import keyed
from tidemark.operators import medallion as M
from tidemark.operators import trend as T
from tidemark.plans import sqlviews as V
from tidemark.plans.catalog import query
from tidemark.sources import views

AS_OF = partial(views.clock, views.AS_OF_ORDERS)


@query("forecast_trend", uses=["series"], sql=f"""
  WITH p AS (SELECT *, make_date(CAST(substr(period, 1, 4) AS INT), CAST(substr(period, 7, 1) AS INT) * 3 - 2, 1) AS d,
      (CAST(substr(period, 1, 4) AS INT) - 1990) * 4 + CAST(substr(period, 7, 1) AS INT) - 1 AS x FROM v_series),
  f AS (SELECT indicator_code, country_code, count(*) AS n, max(d) AS last, max(x) AS x0, regr_slope(value, x) AS b, regr_intercept(value, x) AS a,
      regr_sxy(value, x) AS sxy, regr_syy(value, x) AS syy FROM p GROUP BY ALL HAVING count(*) >= 5),
  h AS (SELECT *, a + b * (x0 + step) AS mid, 1.96::DOUBLE * sqrt(greatest(syy - b * sxy, 0) / (n - 2)) AS half, last + to_months(3 * step) AS day
    FROM f, (SELECT unnest([1, 2, 3, 4]) AS step) WHERE b IS NOT NULL)
  SELECT indicator_code, country_code, CAST(year(day) AS VARCHAR) || '-Q' || CAST(quarter(day) AS VARCHAR) AS period,
    {V.rnd('mid', 4)} AS value, {V.rnd('mid - half', 4)} AS lower, {V.rnd('mid + half', 4)} AS upper, true AS is_forecast, 95e0 AS dq_score FROM h""")
def forecast_trend(spark, folder):
    out = T.forecast(views.series(spark, folder))
    for name in ("value", "lower", "upper"):
        out = out.withColumn(name, rnd(name, 4))
    return out


_BEST = """best AS (SELECT * FROM (SELECT indicator_code, country_code, period_q AS period, record_id, value, dq_score, row_number() OVER (
      PARTITION BY indicator_code, country_code, period_q ORDER BY dq_score DESC, record_id) AS rn FROM v_gold WHERE NOT is_forecast
      AND substr(period_q, 1, 5) || lpad(CAST(CAST(substr(period_q, 7, 1) AS INT) * 3 AS VARCHAR), 2, '0') || '-28' <= '2001-08-02') WHERE rn = 1)"""


def _best(spark, folder):
    g = views.gold(spark, folder).withColumn("period", F.col("period_q"))
    return T.best_per_period(g, AS_OF())


@query("best_per_period", uses=["gold"], sql=f"""
  WITH {_BEST} SELECT indicator_code, country_code, period, record_id, {V.rnd('value', 6)} AS value, dq_score FROM best""")
def best_per_period(spark, folder):
    return _best(spark, folder).withColumn("value", rnd("value", 6))


@query("iqr_fences", uses=["gold"], sql=f"""
  WITH {_BEST}, q AS (SELECT indicator_code, country_code, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM best GROUP BY ALL)
  SELECT indicator_code, country_code, n, {V.rnd('q1', 4)} AS q1, {V.rnd('q3', 4)} AS q3,
    {V.rnd('q1 - 10 * (q3 - q1)', 4)} AS fence_low, {V.rnd('q3 + 10 * (q3 - q1)', 4)} AS fence_high FROM q""")
def iqr_fences(spark, folder):
    out = T.fences(_best(spark, folder))
    return out.select("indicator_code", "country_code", "n", *[rnd(x, 4).alias(x) for x in ("q1", "q3", "fence_low", "fence_high")])


_SPLIT = f"""
  WITH {_BEST},
  q AS (SELECT *, count(*) OVER s AS n, quantile_cont(value, 0.25) OVER s AS q1, quantile_cont(value, 0.75) OVER s AS q3 FROM best
    WINDOW s AS (PARTITION BY indicator_code, country_code)),
  c AS (SELECT *, count(*) OVER (PARTITION BY indicator_code, country_code) AS m FROM q
    WHERE n >= 10 AND (q3 - q1 <= 0 OR (value >= q1 - 10 * (q3 - q1) AND value <= q3 + 10 * (q3 - q1)))),
  w AS (SELECT *, row_number() OVER (PARTITION BY indicator_code, country_code ORDER BY period) AS pos FROM c WHERE n - m <= 0.3 * n AND m >= 10),
  t AS (SELECT *, CASE WHEN m - pos < 5 THEN 'TEST' ELSE 'TRAIN' END AS role FROM w WHERE m - pos < 25)"""


@query("train_test_windows", uses=["gold"], sql=_SPLIT + f"""
  SELECT indicator_code, country_code, period, {V.rnd('value', 6)} AS value, CAST(pos AS INT) AS pos, role FROM t""")
def train_test_windows(spark, folder):
    return T.split_windows(_best(spark, folder)).withColumn("value", rnd("value", 6))


_ANOM = _SPLIT + f""",
  f AS (SELECT *, count(*) FILTER (role = 'TRAIN') OVER s AS nt, regr_slope(y, x) OVER s AS b, regr_intercept(y, x) OVER s AS a,
      regr_sxy(y, x) OVER s AS sxy, regr_syy(y, x) OVER s AS syy
    FROM (SELECT *, CASE WHEN role = 'TRAIN' THEN value END AS y, CASE WHEN role = 'TRAIN' THEN pos::DOUBLE END AS x FROM t)
    WINDOW s AS (PARTITION BY indicator_code, country_code)),
  e AS (SELECT *, a + b * pos AS expected, 1.96::DOUBLE * sqrt(greatest(syy - b * sxy, 0) / (nt - 2)) AS half FROM f WHERE role = 'TEST' AND nt >= 5),
  an AS (SELECT indicator_code, country_code, make_date(CAST(substr(period, 1, 4) AS INT), CAST(substr(period, 7, 1) AS INT) * 3 - 2, 1) AS date,
    value AS actual, expected, expected - half AS lower, expected + half AS upper,
    CASE WHEN half > 0 THEN {V.rnd('(value - expected) / half', 2)} ELSE 0 END AS sigma,
    {V.rnd('CASE WHEN half > 0 THEN (value - expected) / half * 100 WHEN expected <> 0 THEN (value - expected) / abs(expected) * 100 ELSE 0 END', 1)} AS deviation_pct
    FROM e WHERE abs(value - expected) > half)"""
_SHOW = ", ".join(["indicator_code", "country_code", "date", *[f"{V.rnd(c, 4)} AS {c}" for c in ("actual", "expected", "lower", "upper")], "sigma", "deviation_pct"])


def _anomalies(spark, folder):
    return T.anomalies(T.split_windows(_best(spark, folder)))


def _shown(df):
    return df.select("indicator_code", "country_code", "date",
                     *[rnd(c, 4).alias(c) for c in ("actual", "expected", "lower", "upper")], "sigma", "deviation_pct")


@query("anomalies", uses=["gold"], sql=_ANOM + f" SELECT {_SHOW} FROM an")
def anomalies(spark, folder):
    return _shown(T.ranked(_anomalies(spark, folder)))


@query("anomalies_custom_model", uses=["gold"], sql=_SPLIT + f""",
  m AS (SELECT *, count(*) FILTER (role = 'TRAIN') OVER s AS nt, median(CASE WHEN role = 'TRAIN' THEN value END) OVER s AS expected FROM t
    WINDOW s AS (PARTITION BY indicator_code, country_code)),
  d AS (SELECT *, {K.ROBUST_WIDTH}::DOUBLE * median(CASE WHEN role = 'TRAIN' THEN abs(value - expected) END)
    OVER (PARTITION BY indicator_code, country_code) AS half FROM m)
  SELECT indicator_code, country_code, period, {V.rnd('value', 4)} AS actual, {V.rnd('expected', 4)} AS expected,
    {V.rnd('expected - half', 4)} AS lower, {V.rnd('expected + half', 4)} AS upper, abs(value - expected) > half AS outside
  FROM d WHERE role = 'TEST' AND nt >= {K.MIN_TRAIN_POINTS}""")
def anomalies_custom_model(spark, folder):
    found = T.with_model(T.split_windows(_best(spark, folder)), T.robust_band, T.ROBUST_SCHEMA)
    return found.select("indicator_code", "country_code", "period", *[rnd(c, 4).alias(c) for c in ("actual", "expected", "lower", "upper")], "outside")


@query("anomaly_ticker", uses=["gold"], sql=_ANOM + """
  SELECT indicator_code, country_code, date, sigma FROM an ORDER BY abs(sigma) DESC, indicator_code, country_code, date LIMIT 4""")
def anomaly_ticker(spark, folder):
    return T.ranked(_anomalies(spark, folder), 4, "sigma").select("indicator_code", "country_code", "date", "sigma")


_REF = """,
  y AS (SELECT indicator_code, year(date) AS year, count(DISTINCT country_code) AS covered FROM an GROUP BY ALL),
  tt AS (SELECT indicator_code, count(DISTINCT country_code) AS total FROM an GROUP BY ALL),
  ref AS (SELECT * FROM (SELECT indicator_code, year, covered, total, row_number() OVER (PARTITION BY indicator_code
      ORDER BY covered = total DESC, covered DESC, year DESC) AS rn FROM y JOIN tt USING (indicator_code)) WHERE rn = 1)"""


@query("anomaly_reference_year", uses=["gold"], sql=_ANOM + _REF + " SELECT indicator_code, CAST(year AS INT) AS year, covered, total FROM ref")
def anomaly_reference_year(spark, folder):
    return T.reference_years(_anomalies(spark, folder))


@query("anomaly_linked_view", uses=["gold"], sql=_ANOM + _REF + f"""
  SELECT indicator_code, country_code, date, {V.rnd('actual', 4)} AS actual, {V.rnd('expected', 4)} AS expected, sigma, deviation_pct FROM (
    SELECT an.*, row_number() OVER (PARTITION BY an.indicator_code, country_code ORDER BY abs(sigma) DESC, date DESC) AS k
    FROM an JOIN ref ON an.indicator_code = ref.indicator_code AND year(date) = ref.year) WHERE k = 1""")
def anomaly_linked_view(spark, folder):
    out = T.linked_view(_anomalies(spark, folder))
    return out.withColumn("actual", rnd("actual", 4)).withColumn("expected", rnd("expected", 4))


def _signed(expr: str, digits: int) -> str:
    return f"CASE WHEN {V.rnd(expr, digits)} >= 0 THEN '+' ELSE '' END || {V.fixed(expr, digits)}"


@query("anomaly_explanations", uses=["gold"], sql=f"""
  WITH s AS (SELECT a.record_id AS sid, max_by(b.value, (b.promoted_at, b.record_id)) FILTER (b.record_id IS NOT NULL) AS prev
    FROM v_gold a LEFT JOIN v_gold b ON NOT b.is_forecast AND (b.tenant_id IS NULL OR b.tenant_id = a.tenant_id)
      AND a.indicator_code = b.indicator_code AND a.country_code = b.country_code AND a.period = b.period
      AND (b.promoted_at < a.promoted_at OR b.promoted_at = a.promoted_at AND b.record_id < a.record_id) GROUP BY 1),
  r AS (SELECT v_gold.*, prev FROM v_gold JOIN s ON record_id = sid),
  n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY indicator_code, country_code ORDER BY promoted_at DESC, record_id DESC) AS rn FROM r) WHERE rn = 1),
  h AS (SELECT indicator_code, country_code, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS low, max(value) AS high FROM (
      SELECT g.*, row_number() OVER (PARTITION BY g.indicator_code, g.country_code ORDER BY g.promoted_at DESC, g.record_id DESC) AS k
      FROM v_gold g JOIN n ON g.indicator_code = n.indicator_code AND g.country_code = n.country_code AND g.period <> n.period) WHERE k <= 10 GROUP BY ALL),
  j AS (SELECT n.indicator_code, n.country_code, record_id, standard_unit, promoted_at, value, prev, value - prev AS delta, value - (value - prev) AS old,
      coalesce(mean, value) AS mean, coalesce(low, value) AS low, coalesce(high, value) AS high,
      {V.rnd('CASE WHEN sd > 0 THEN abs(value - mean) / sd ELSE 0 END', 6)} AS z FROM n LEFT JOIN h ON n.indicator_code = h.indicator_code AND n.country_code = h.country_code),
  p AS (SELECT *, {V.rnd(f"CASE WHEN {V.rnd('old', 6)} <> 0 THEN delta / old * 100 ELSE 0 END", 4)} AS pct FROM j)
  SELECT indicator_code, country_code, record_id, CASE WHEN prev IS NOT NULL THEN 'REVISION' ELSE 'OUT_OF_RANGE' END AS anomaly_type,
    CASE WHEN prev IS NOT NULL THEN 'This indicator was revised on ' || CAST(CAST(promoted_at AS DATE) AS VARCHAR) || '. Original: ' || {V.plain('old')} ||
        '. Revised: ' || {V.plain('value')} || '. Change: ' || {_signed('delta', 3)} || ' (' || {_signed('pct', 1)} || '%).'
      ELSE 'This value (' || {V.plain('value')} || ' ' || standard_unit || ') is ' || {V.fixed('z', 1)} || ' standard deviations from the historical mean (' ||
        {V.fixed('mean', 2)} || ' ' || standard_unit || '). Typical range: ' || {V.fixed('low', 2)} || ' to ' || {V.fixed('high', 2)} || '.' END AS explanation,
    CASE WHEN prev IS NOT NULL THEN CASE WHEN abs(pct) > 10 THEN 'HIGH' WHEN abs(pct) > 5 THEN 'MEDIUM' ELSE 'LOW' END
      ELSE CASE WHEN z > 3 THEN 'HIGH' WHEN z > 2 THEN 'MEDIUM' ELSE 'LOW' END END AS severity FROM p""")
def anomaly_explanations(spark, folder):
    flagged = M.flag_revisions(views.gold(spark, folder).select(
        "record_id", "tenant_id", "indicator_code", "country_code", "period", "value", "standard_unit", "is_forecast", "promoted_at"))
    return T.explain_latest(flagged)


@query("history_stats", uses=["gold"], sql=f"""
  WITH n AS (SELECT indicator_code, country_code, max(period) AS p FROM v_gold GROUP BY ALL),
  k AS (SELECT g.*, row_number() OVER (PARTITION BY g.indicator_code, g.country_code ORDER BY promoted_at DESC, record_id DESC) AS k FROM v_gold g
    JOIN n ON g.indicator_code = n.indicator_code AND g.country_code = n.country_code AND g.period <> n.p)
  SELECT indicator_code, country_code, count(*) AS n, {V.rnd('avg(value)', 4)} AS mean, {V.rnd('coalesce(stddev_samp(value), 0)', 4)} AS std,
    {V.rnd('min(value)', 4)} AS low, {V.rnd('max(value)', 4)} AS high FROM k WHERE k <= 10 GROUP BY ALL""")
def history_stats(spark, folder):
    g = views.gold(spark, folder)
    focus = g.groupBy("indicator_code", "country_code").agg(F.max("period").alias("period"))
    out = T.history_stats(g, focus)
    return out.select("indicator_code", "country_code", "n", *[rnd(x, 4).alias(x) for x in ("mean", "std", "low", "high")])


@query("conflict_explanations", uses=["candidates"], sql=f"""
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY indicator_code, country_code, period ORDER BY reliability DESC, source_code) AS k FROM v_candidates),
  p AS (SELECT a.indicator_code, a.country_code, a.period, a.source_code AS sa, a.value AS va, a.reliability AS ra, b.source_code AS sb, b.value AS vb,
    {V.rnd('CASE WHEN (a.value + b.value) / 2 <> 0 THEN abs(a.value - b.value) / ((a.value + b.value) / 2) * 100 ELSE 0 END', 6)} AS v
    FROM r a JOIN r b ON a.indicator_code = b.indicator_code AND a.country_code = b.country_code AND a.period = b.period AND a.k = 1 AND b.k = 2)
  SELECT indicator_code, country_code, period, v AS variance_pct, 'Source ''' || sa || ''' reports ' || {V.plain('va')} || '; Source ''' || sb || ''' reports ' ||
    {V.plain('vb')} || '. Variance: ' || {V.fixed('v', 1)} || '%. Using ''' || sa || ''' (reliability score: ' || {V.fixed('ra', 0)} || '/100).' AS explanation,
    CASE WHEN v > 5 THEN 'HIGH' WHEN v > 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM p""")
def conflict_explanations(spark, folder):
    """The two most reliable candidates of each key with at least two."""
    key = ["indicator_code", "country_code", "period"]
    top = keyed.top_per_key(views.candidates(spark, folder), key, [F.col("reliability").desc(), F.col("source_code")], 2)
    side = F.struct("source_code", "value", "reliability")
    pair = top.groupBy(*key).agg(
        F.max(F.when(F.col("rank") == 1, side)).alias("a"), F.max(F.when(F.col("rank") == 2, side)).alias("b")
    ).filter(F.col("b").isNotNull()).select(
        *key, F.col("a.source_code").alias("source_a"), F.col("a.value").alias("value_a"),
        F.col("a.reliability").alias("reliability_a"), F.col("b.source_code").alias("source_b"), F.col("b.value").alias("value_b"),
    )
    return T.explain_conflicts(pair).select(*key, "variance_pct", "explanation", "severity")
