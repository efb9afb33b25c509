"""DuckDB text of the logical tables, used only to check the Spark results."""

from __future__ import annotations

from tidemark import constants as K
from tidemark.sources.views import AS_OF_EVENTS, AS_OF_ORDERS

E = f"TIMESTAMP '{AS_OF_EVENTS}'"
O = f"TIMESTAMP '{AS_OF_ORDERS}'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rnd(expr: str, digits: int) -> str:
    return f"(floor(({expr}) * 1e{digits} + 0.5) / 1e{digits})"


def fixed(expr: str, digits: int) -> str:
    if digits == 0:
        return f"CAST(CAST(floor(({expr}) + 0.5) AS BIGINT) AS VARCHAR)"
    return f"CAST(CAST({rnd(expr, digits)} AS DECIMAL(38,{digits})) AS VARCHAR)"


def plain(expr: str) -> str:
    text = f"rtrim(CAST(CAST({rnd(expr, 6)} AS DECIMAL(38,6)) AS VARCHAR), '0')"
    return f"(CASE WHEN {text} LIKE '%.' THEN {text} || '0' ELSE {text} END)"


def pick(index: str, values: list) -> str:
    items = ", ".join(q(v) if isinstance(v, str) else repr(v) for v in values)
    return f"([{items}])[{index} + 1]"


def case_map(expr: str, table: dict, default: str = "NULL") -> str:
    def lit(x):
        return q(x) if isinstance(x, str) else (f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else repr(x))
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"(CASE {expr} {arms} ELSE {default} END)"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


UNIT = {k: v[2] for k, v in K.INDICATORS.items()}

VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, deps: list[str], body: str) -> None:
    VIEWS[name] = (deps, body)


view("bronze", [], f"""
  SELECT record_id, tenant_id, source_code, indicator_code, country_code, period, raw_value, crawled_at,
         source_url, standard_unit,
         CASE record_id % 6 WHEN 0 THEN 'percent' WHEN 1 THEN '%' WHEN 2 THEN 'USD billions'
              WHEN 3 THEN standard_unit WHEN 5 THEN 'index' END AS raw_unit
  FROM (
    SELECT *, {case_map('indicator_code', UNIT)} AS standard_unit FROM (
    SELECT event_id AS record_id,
      CASE WHEN user_id % 4 <> 0 THEN user_id % 4 END AS tenant_id,
      {pick('event_id % 3', ['WORLD_BANK', 'IMF_WEO', 'FRED'])} AS source_code,
      CASE WHEN event_id % 97 <> 0 THEN CASE event_type WHEN 'click' THEN 'GDP_GROWTH' WHEN 'view' THEN 'CPI_INFLATION'
        WHEN 'signup' THEN 'UNEMPLOYMENT_RATE' WHEN 'purchase' THEN 'GDP_CURRENT_USD' WHEN 'error' THEN 'POPULATION' END END AS indicator_code,
      {pick('user_id % 20', K.COUNTRIES)} AS country_code,
      CASE WHEN event_id % 5 <= 1 THEN y
           WHEN event_id % 5 = 2 THEN y || '-Q' || CAST(1 + event_id % 4 AS VARCHAR)
           WHEN event_id % 5 = 3 THEN y || '-' || lpad(CAST(1 + event_id % 12 AS VARCHAR), 2, '0')
           WHEN event_id % 35 = 4 THEN 'latest' ELSE y || '-06-01' END AS period,
      CASE WHEN event_id % 12 <= 4 THEN v WHEN event_id % 12 = 5 THEN v || '%' WHEN event_id % 12 = 6 THEN '$' || v || 'T'
           WHEN event_id % 12 = 7 THEN v || 'B' WHEN event_id % 12 = 8 THEN v || ' million'
           WHEN event_id % 12 = 9 THEN v || '% (forecast)'
           WHEN event_id % 24 = 10 THEN 'N/A' WHEN event_id % 12 = 10 THEN v || ' percent'
           WHEN event_id % 36 = 23 THEN '' WHEN event_id % 36 = 35 THEN '..' END AS raw_value,
      ts - to_days(CAST(event_id % 120 AS INTEGER)) AS crawled_at,
      'https://example.org/' || CAST(event_id AS VARCHAR) AS source_url
    FROM (SELECT *, CAST(2024 - event_id % 9 AS VARCHAR) AS y,
            CAST(cents // 1000 AS VARCHAR) || '.' || lpad(CAST(cents % 1000 AS VARCHAR), 3, '0') AS v
          FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events))))""")

_low = case_map("indicator_code", {k: v[0] for k, v in K.INDICATOR_BOUNDS.items()})
_high = case_map("indicator_code", {k: v[1] for k, v in K.INDICATOR_BOUNDS.items()})
_ulow = case_map("standard_unit", {k: v[0] for k, v in K.UNIT_BOUNDS.items() if v[0] is not None})
_uhigh = case_map("standard_unit", {k: v[1] for k, v in K.UNIT_BOUNDS.items() if v[1] is not None})
_missing = in_list(K.MISSING_FIELD_TOKENS)
_pct = "|".join(K.PCT_UNIT_WORDS)

view("parsed", ["bronze"], f"""
  SELECT *, CASE WHEN s IS NULL AND standard_unit = 'USD_BN' AND abs(n) >= 1e9 THEN n / 1e9
                 WHEN s IS NULL AND standard_unit = 'MILLIONS' AND abs(n) >= 1e6 THEN n / 1e6
                 ELSE n * CASE s WHEN 't' THEN CAST(1000 AS DOUBLE) WHEN 'm' THEN CAST(0.001 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END END AS value,
    coalesce(regexp_matches(lower(raw_value), '{'|'.join(K.FORECAST_WORDS_RAW)}'), false) AS is_forecast
  FROM (SELECT *, TRY_CAST(regexp_replace(CASE WHEN s IS NULL THEN raw ELSE rtrim(raw, s) END, '[^\\d.\\-]', '', 'g') AS DOUBLE) AS n
    FROM (SELECT *, CASE WHEN raw LIKE '%t' OR lower(raw_value) LIKE '%trillion%' THEN 't'
                         WHEN raw LIKE '%b' OR lower(raw_value) LIKE '%billion%' THEN 'b'
                         WHEN raw LIKE '%m' OR lower(raw_value) LIKE '%million%' THEN 'm' END AS s
      FROM (SELECT *, regexp_replace(lower(raw_value), '[,$€£¥%\\s]', '', 'g') AS raw FROM bronze)))""")

view("silver", ["parsed"], f"""
  SELECT *, CASE WHEN dq_score >= 90 THEN 'AUTO_PROMOTED' WHEN dq_score >= 70 THEN 'REVIEW' ELSE 'REJECTED' END AS dq_status,
    concat_ws(';',
      CASE WHEN value IS NULL THEN 'value_not_parseable' END,
      CASE WHEN value < lo THEN 'value_' || {plain('value')} || '_below_min_' || {plain('lo')} END,
      CASE WHEN value > hi THEN 'value_' || {plain('value')} || '_above_max_' || {plain('hi')} END,
      CASE WHEN m1 THEN 'missing_indicator_code' END, CASE WHEN m2 THEN 'missing_country_code' END,
      CASE WHEN m3 THEN 'missing_period' END, CASE WHEN m4 THEN 'missing_raw_value' END,
      CASE WHEN yr IS NULL THEN 'period_format_unrecognized'
           WHEN years_old > 5 THEN 'data_' || CAST(years_old AS VARCHAR) || '_years_old'
           WHEN age > 90 THEN 'crawled_' || CAST(age AS VARCHAR) || '_days_ago' END,
      CASE WHEN standard_unit IS NULL THEN 'missing_standard_unit'
           WHEN clash THEN 'unit_mismatch_raw=' || raw_unit || '_expected_PCT' END) AS reasons
  FROM (SELECT *, {rnd('CAST(0.4 AS DOUBLE) * accuracy + CAST(0.3 AS DOUBLE) * completeness + CAST(0.2 AS DOUBLE) * timeliness + CAST(0.1 AS DOUBLE) * consistency', 2)} AS dq_score
  FROM (SELECT *,
      CASE WHEN value IS NULL THEN CAST(0 AS DOUBLE) WHEN value < lo OR value > hi THEN CAST(20 AS DOUBLE) ELSE CAST(100 AS DOUBLE) END AS accuracy,
      CAST(100 - 25 * (CAST(m1 AS INT) + CAST(m2 AS INT) + CAST(m3 AS INT) + CAST(m4 AS INT)) AS DOUBLE) AS completeness,
      CAST(CASE WHEN yr IS NULL THEN 70 WHEN years_old > 5 THEN 50 WHEN age > 90 THEN 70 ELSE 100 END AS DOUBLE) AS timeliness,
      CAST(CASE WHEN standard_unit IS NULL THEN 50 WHEN clash THEN 60 ELSE 100 END AS DOUBLE) AS consistency
  FROM (SELECT *, coalesce({_low}, {_ulow}) AS lo, coalesce({_high}, {_uhigh}) AS hi,
      (indicator_code IS NULL OR trim(indicator_code) IN {_missing}) AS m1,
      (country_code IS NULL OR trim(country_code) IN {_missing}) AS m2,
      (period IS NULL OR trim(period) IN {_missing}) AS m3,
      (raw_value IS NULL OR trim(raw_value) IN {_missing}) AS m4,
      TRY_CAST(regexp_extract(period, '(\\d{{4}})', 1) AS INT) AS yr,
      2024 - TRY_CAST(regexp_extract(period, '(\\d{{4}})', 1) AS INT) AS years_old,
      date_sub('day', crawled_at, {E}) AS age,
      (standard_unit = 'PCT' AND coalesce(trim(raw_unit), '') NOT IN ('', 'None') AND NOT regexp_matches(lower(raw_unit), '{_pct}')) AS clash
  FROM parsed)))""")

view("gold", [], f"""
  SELECT *, CASE WHEN digit <= 3 THEN (cents - 25000000) / 1e6 WHEN digit = 4 THEN cents / 250000e0 ELSE cents / 100000e0 END AS value,
      CASE WHEN dq_score < 90 THEN 'analyst' || CAST(customer_id % 3 AS VARCHAR) ELSE 'auto' END AS approved_by
  FROM (SELECT o_orderkey AS record_id, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 4 END AS tenant_id, o_orderkey AS silver_id,
      {pick('digit - 1', ['GDP_GROWTH', 'CPI_INFLATION', 'UNEMPLOYMENT_RATE', 'GOVT_DEBT_PCT_GDP', 'GDP_CURRENT_USD'])} AS indicator_code,
      n_name AS country_code, r_name AS region, CAST(year(o_orderdate) AS VARCHAR) AS period,
      CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS period_q, digit,
      CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
      {pick('digit - 1', ['PCT', 'PCT', 'PCT', 'PCT_GDP', 'USD_BN'])} AS standard_unit,
      c_mktsegment AS source_code,
      CAST(80 + 3 * (list_position(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], c_mktsegment) - 1) AS DOUBLE) AS reliability,
      o_orderdate AS crawled_at, o_orderdate + to_seconds(o_orderkey % 86400) AS promoted_at,
      CAST(60 + o_orderkey % 41 AS DOUBLE) AS dq_score, o_orderkey % 10 = 0 AS is_forecast, o_custkey AS customer_id
    FROM (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INT) AS digit FROM orders)
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""")

view("candidates", ["gold"], f"""
  SELECT * REPLACE (100 + (record_id % 13) * {pick('digit - 1', [0.02, 0.05, 0.1, 0.3, 1.0])}::DOUBLE AS value)
  FROM (SELECT *, row_number() OVER (PARTITION BY indicator_code, country_code, period, source_code
                                     ORDER BY promoted_at DESC, record_id DESC) AS rn FROM gold) WHERE rn = 1""")

view("series", ["gold"], """
  SELECT indicator_code, country_code, period, dq_score,
    CASE WHEN digit <= 3 THEN (mc - 25000000) / 1e6 WHEN digit = 4 THEN mc / 250000e0 ELSE mc / 100000e0 END AS value
  FROM (SELECT indicator_code, country_code, digit, period_q AS period, CAST(sum(cents) AS BIGINT) / count(*) AS mc, max(dq_score) AS dq_score
        FROM gold WHERE NOT is_forecast GROUP BY ALL)""")

view("supply", [], f"""
  SELECT l_suppkey AS source_code, l_shipdate AS crawled_at, CASE WHEN l_orderkey % 11 <> 0 THEN l_orderkey END AS raw_value,
    60 + l_partkey % 41 AS dq_score, CASE l_returnflag WHEN 'N' THEN 'ROUTINE' WHEN 'A' THEN 'MODERATE' ELSE 'MAJOR' END AS severity,
    (l_linestatus = 'F' AND l_linenumber = 1) AS is_revision,
    {pick('l_linenumber % 4', ['groq', 'gemini', 'openrouter', 'cerebras'])} AS provider,
    CAST(l_quantity AS BIGINT) * 100 AS tokens FROM lineitem""")
view("supply_sources", [], """
  SELECT s_suppkey AS source_code, s_acctbal AS reputation, s_suppkey % 5 = 0 AS has_error, s_suppkey % 7 <> 0 AS is_active FROM supplier""")

view("messages", [], """
  SELECT conv_id AS session_id, turn, role, text, conv_id % 60 AS user_id,
    CASE WHEN turn <= 1 THEN conv_id * 7 + turn END AS record_id FROM conversations""")
view("sessions", ["messages"], """
  SELECT session_id, user_id, max(turn) AS last_active, count(*) AS n_messages FROM messages GROUP BY ALL""")
view("exchanges", ["messages"], """
  SELECT a.session_id, a.turn, a.text AS query, b.text AS response FROM messages a JOIN messages b
  ON a.session_id = b.session_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'""")
view("news", [], f"""
  SELECT doc_id AS news_id, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 4 END AS tenant_id, substr(text, 1, 80) AS title, text AS content,
    source AS source_name, {pick('doc_id % 20', K.COUNTRIES)} AS country_code,
    CASE WHEN doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 30 AS INT)) END AS published_at FROM documents""")
view("hits", [], f"""
  SELECT event_id * 12 + k AS hit_id, user_id AS identifier, {pick('user_id % 3', ['PUBLIC', 'EXTERNAL_BUSINESS', 'ADMIN'])} AS role,
    ts + to_seconds(k * (event_id % 19 + 7)) AS hit_at FROM (SELECT *, unnest(range(event_id % 12 + 1)) AS k FROM events)""")
view("blocks", [], """
  SELECT event_id AS block_id, user_id AS source_url, ts AS blocked_at FROM events WHERE event_type = 'error'""")
view("crawl_log", [], """
  SELECT event_id AS log_id, user_id AS source_code,
    CASE event_type WHEN 'click' THEN 'PROCEED' WHEN 'view' THEN 'PROCEED' WHEN 'signup' THEN 'SKIP' WHEN 'error' THEN 'DEFER' END AS action,
    substr(sha256(CAST(event_id % 3 AS VARCHAR)), 1, 16) AS content_hash, ts AS logged_at FROM events""")
view("consent_events", [], f"""
  SELECT event_id, user_id, {pick('event_id % 3', ['ANALYTICS', 'PERSONALIZATION', 'MARKETING'])} AS consent_type,
    CASE event_type WHEN 'signup' THEN 'grant' ELSE 'revoke' END AS action, ts AS noted_at
  FROM events WHERE event_type IN ('signup', 'error')""")
view("tasks", [], f"""
  SELECT event_id AS task_id, CASE WHEN event_id % 3 <> 0 THEN 'PENDING' ELSE 'RESOLVED' END AS status,
    CAST(event_id % 4 + 2 AS INT) AS level, ts AS assigned_at,
    ts + to_hours({pick('event_id % 4', [4, 8, 24, 48])}) AS sla_deadline FROM events""")
view("cost_events", [], f"""
  SELECT event_id AS cost_id, user_id AS source_id, {pick('event_id % 3', ['LLM', 'CRAWLER', 'STORAGE'])} AS category,
    CASE WHEN event_id % 3 = 0 THEN {pick('event_id % 4', ['groq', 'gemini', 'openrouter', 'cerebras'])} END AS provider,
    CAST(round(value * 100) AS BIGINT) AS quantity, ts AS occurred_at FROM events""")


def compose(deps: list[str], select: str) -> str:
    """``WITH`` chain of the needed views (in dependency order) before ``select``."""
    order: list[str] = []

    def visit(name: str) -> None:
        for d in VIEWS[name][0]:
            visit(d)
        if name not in order:
            order.append(name)

    for d in deps:
        visit(d)
    ctes = [f"v_{n} AS ({_refer(VIEWS[n][1], VIEWS[n][0])})" for n in order]
    body = select.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*ctes, body[15:]])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*ctes, body[5:]])
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body


def _refer(body: str, deps: list[str]) -> str:
    for d in deps:
        body = body.replace(f"FROM {d}", f"FROM v_{d}").replace(f"JOIN {d} ", f"JOIN v_{d} ")
    return body
