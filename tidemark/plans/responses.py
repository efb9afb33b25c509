"""Privacy, safety, grounding and citation queries over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import text
from tidemark.functions.numeric import rnd
from tidemark.operators import responses as R
from tidemark.plans import sqlviews as V
from tidemark.plans.catalog import query
from tidemark.sources import views
from tidemark.sources.tables import spread, table


def _sql_pii(name: str) -> str:
    return K.PII_PATTERNS[name]


def _redact_sql(column: str) -> str:
    out = column
    for name in K.PII_ORDER:
        out = f"regexp_replace({out}, {V.q(_sql_pii(name))}, '[REDACTED_{name}]', 'g')"
    return out


_N_PII = ", ".join(
    f"CAST(len(regexp_extract_all(text, {V.q(_sql_pii(n))})) AS INT) AS n_{n.lower()}" for n in K.PII_PATTERNS
)


@query("pii_redaction", sql=f"""
  SELECT doc_id, {_redact_sql('text')} AS redacted, {_N_PII}, sha256(text) AS text_hash FROM documents""")
def pii_redaction(spark, folder):
    return R.redact_table(spread(table(spark, folder, "documents")), "doc_id")


@query("privacy_audit", sql=f"""
  WITH c AS (SELECT doc_id, sha256(text) AS text_hash, {_N_PII} FROM documents),
  a AS (SELECT doc_id, text_hash, concat_ws(',', {', '.join(f"CASE WHEN n_{n.lower()} > 0 THEN '{n}' END" for n in K.PII_PATTERNS)}) AS pii_types FROM c)
  SELECT * FROM a WHERE pii_types <> ''""")
def privacy_audit(spark, folder):
    return R.privacy_audit(R.redact_table(spread(table(spark, folder, "documents")), "doc_id"), "doc_id")


_ADVICE, _DOMAIN, _DISC = ("|".join(w) for w in (K.ADVICE_WORDS, K.DOMAIN_WORDS, K.DISCLAIMER_WORDS))
_GUARD = f"""
  WITH g AS (SELECT *, CASE WHEN regexp_matches(lower(response), '{_ADVICE}') THEN 'InvestmentAdviceFilter'
      WHEN NOT regexp_matches(lower(query), '{_DOMAIN}') THEN 'ScopeFilter' END AS triggered_filter FROM src),
  f AS (SELECT *, CASE triggered_filter WHEN 'InvestmentAdviceFilter' THEN {V.q(K.ADVICE_REFUSAL)} WHEN 'ScopeFilter' THEN {V.q(K.SCOPE_REFUSAL)}
      ELSE response || CASE WHEN regexp_matches(lower(response), '{_DISC}') AND NOT contains(response, {V.q(K.DISCLAIMER)}) THEN {V.q(K.DISCLAIMER)} ELSE '' END END AS final_response FROM g)"""


@query("guardrails", uses=["exchanges"], sql=_GUARD.replace("FROM src", "FROM v_exchanges") + """
  SELECT session_id, turn, triggered_filter, triggered_filter IS NULL AS passed, final_response, CAST(length(final_response) AS INT) AS response_length, sha256(query) AS query_hash FROM f""")
def guardrails(spark, folder):
    return R.guard(views.exchanges(spark, folder))


@query("guardrails_documents", sql=_GUARD.replace("FROM src", "FROM (SELECT doc_id, text AS query, text AS response FROM documents)") + """
  SELECT triggered_filter, count(*) AS n, CAST(sum(length(final_response)) AS BIGINT) AS chars FROM f GROUP BY ALL""")
def guardrails_documents(spark, folder):
    """The same filters with every document as both question and answer."""
    docs = spread(table(spark, folder, "documents")).select("doc_id", F.col("text").alias("query"), F.col("text").alias("response"))
    return R.guard(docs).groupBy("triggered_filter").agg(
        F.count(F.lit(1)).alias("n"), F.sum("response_length").alias("chars")
    )


# The document text is extended by a sentence that reports a published value, so that
# responses hold numbers and inline citations.
_RESPONSES_SQL = f"""SELECT o_orderkey AS run_id, text || ' The reading was ' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) // 1000000 AS VARCHAR) || '.' ||
    lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) // 10000 % 100 AS VARCHAR), 2, '0') || '% [Source: ' || source || ', ' || CAST(year(o_orderdate) AS VARCHAR) || '].' AS text
  FROM documents JOIN orders ON doc_id = o_orderkey"""


def _responses(spark, folder):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    docs = spread(table(spark, folder, "documents")).select("doc_id", "text", "source")
    return docs.join(table(spark, folder, "orders"), F.col("doc_id") == F.col("o_orderkey")).select(
        F.col("doc_id").alias("run_id"),
        F.concat(
            F.col("text"), F.lit(" The reading was "), F.floor(cents / 1000000).cast("string"), F.lit("."),
            F.lpad((F.floor(cents / 10000) % 100).cast("string"), 2, "0"), F.lit("% [Source: "), F.col("source"),
            F.lit(", "), F.year("o_orderdate").cast("string"), F.lit("]."),
        ).alias("text"),
    )


_BUCKETED = f"""
  WITH r AS ({_RESPONSES_SQL}),
  t AS (SELECT run_id, list_transform_ AS x FROM r, LATERAL (SELECT unnest(regexp_extract_all(text, {V.q(K.NUMBER_CLAIM)}, 1)) AS list_transform_)),
  n AS (SELECT run_id, CAST(x AS DOUBLE) AS x FROM t WHERE CAST(x AS DOUBLE) > 0.01::DOUBLE AND CAST(x AS DOUBLE) < 1000),
  d AS (SELECT DISTINCT x FROM n),
  h AS (SELECT x, EXISTS (SELECT 1 FROM v_gold WHERE value >= x * 0.9::DOUBLE AND value <= x * 1.1::DOUBLE) AS hit FROM d),
  c AS (SELECT run_id, count(*) AS n, count(*) FILTER (hit) AS m FROM n JOIN h USING (x) GROUP BY ALL)"""
_MARKS = " OR ".join(f"regexp_matches(text, {V.q(p)})" for p in K.CITATION_MARKERS)
_OUTPUT = _BUCKETED + f""",
  o AS (SELECT r.run_id, coalesce(n, 0) AS n_numbers, coalesce(m, 0) AS n_matched,
    CASE WHEN n IS NULL THEN 0.8::DOUBLE WHEN m = 0 THEN 0.4::DOUBLE ELSE least(1, m / 5e0) END AS confidence,
    concat_ws(';', CASE WHEN NOT ({_MARKS}) THEN 'Response missing source citation' END, CASE WHEN length(text) < 50 THEN 'Response too short (< 50 chars)' END,
      CASE WHEN length(text) > 4000 THEN 'Response too long (> 4000 chars)' END,
      CASE WHEN n > 0 AND m = 0 THEN 'Numeric values could not be cross-referenced against Gold layer' END) AS issues
    FROM r LEFT JOIN c ON r.run_id = c.run_id)"""


@query("output_validation", uses=["gold"], sql=_OUTPUT + " SELECT *, issues = '' AS valid FROM o")
def output_validation(spark, folder):
    out = R.validate_output(_responses(spark, folder), views.gold(spark, folder), "run_id")
    return out.withColumn("issues", F.array_join("issues", ";"))


_GROUND = f"""
  gr AS ({_RESPONSES_SQL}),
  gt AS (SELECT run_id, tok, CAST(tok AS DOUBLE) AS x FROM (SELECT run_id, unnest(regexp_extract_all(text, '{K.NUMBER_PLAIN}')) AS tok FROM gr)),
  gs AS (SELECT *, row_number() OVER () AS id FROM gt WHERE NOT (x BETWEEN 1900 AND 2100 AND NOT contains(tok, '.')) AND (abs(x) >= 0.01::DOUBLE OR contains(tok, '.'))),
  gv AS (SELECT customer_id AS run_id, value FROM v_gold),
  gm AS (SELECT gs.run_id, id, bool_or(CASE WHEN value = 0 THEN abs(x) < 0.05::DOUBLE ELSE x >= value - greatest(0.05::DOUBLE, abs(value) * 0.05::DOUBLE) AND x <= value + greatest(0.05::DOUBLE, abs(value) * 0.05::DOUBLE) END) AS ok
    FROM gs LEFT JOIN gv ON gs.run_id = gv.run_id GROUP BY ALL),
  gn AS (SELECT run_id, count(*) AS n, count(*) FILTER (NOT coalesce(ok, false)) AS u FROM gm GROUP BY ALL),
  gg AS (SELECT run_id, count(*) AS g FROM gv GROUP BY ALL),
  gj AS (SELECT gr.run_id, coalesce(n, 0) AS n_numbers, coalesce(g, 0) AS n_grounded, coalesce(u, 0) AS n_unmatched FROM gr LEFT JOIN gn USING (run_id) LEFT JOIN gg USING (run_id)),
  ground AS (SELECT *, CASE WHEN n_numbers > 0 AND n_grounded = 0 THEN 'low' WHEN n_numbers = 0 OR n_unmatched = 0 THEN 'high' WHEN n_unmatched / n_numbers >= 0.5 THEN 'low' ELSE 'medium' END AS confidence,
    CASE WHEN n_numbers > 0 AND n_grounded = 0 THEN 'Response contains numeric claims but no grounded data was retrieved.'
      WHEN n_numbers > 0 AND n_unmatched > 0 THEN CAST(n_unmatched AS VARCHAR) || ' of ' || CAST(n_numbers AS VARCHAR) || ' numeric values could not be verified against retrieved data.' END AS warning FROM gj)"""


def _values(spark, folder):
    return views.gold(spark, folder).select(F.col("customer_id").alias("run_id"), "value")


@query("grounding", uses=["gold"], sql="WITH " + _GROUND + " SELECT * FROM ground")
def grounding(spark, folder):
    return R.grounding(_responses(spark, folder), _values(spark, folder), "run_id")


@query("confidence_merge", uses=["gold"], sql=_OUTPUT + "," + _GROUND + """
  SELECT o.run_id, CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.5 THEN 'medium' ELSE 'low' END AS final_confidence FROM (
    SELECT run_id, least(o.confidence, CASE g.confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 0.5 ELSE 0.2 END)::DOUBLE AS s FROM o JOIN ground g USING (run_id)) o""")
def confidence_merge(spark, folder):
    answers = _responses(spark, folder)
    checked = R.validate_output(answers, views.gold(spark, folder), "run_id").select("run_id", F.col("confidence").alias("_v"))
    grounded = R.grounding(answers, _values(spark, folder), "run_id")
    return grounded.join(checked, "run_id").select(
        "run_id", R.merge_confidence(F.col("confidence"), F.col("_v")).alias("final_confidence")
    )


@query("inline_citations", sql=f"""
  WITH r AS ({_RESPONSES_SQL}), x AS (SELECT run_id, unnest(regexp_extract_all(text, {V.q(K.INLINE_CITATION)}, 1)) AS s, unnest(regexp_extract_all(text, {V.q(K.INLINE_CITATION)}, 2)) AS p FROM r)
  SELECT run_id, trim(s) AS source_name, trim(p) AS period FROM x""")
def inline_citations(spark, folder):
    return _responses(spark, folder).select("run_id", F.inline(text.inline_citations(F.col("text"))))


@query("citation_styles", sql=f"""
  WITH r AS ({_RESPONSES_SQL} UNION ALL SELECT -1 - doc_id, text FROM documents)
  SELECT run_id, ({' OR '.join(f"regexp_matches(text, {V.q(p)})" for p in K.CITATION_STYLES)}) AS cited, ({_MARKS}) AS marked FROM r""")
def citation_styles(spark, folder):
    plain_docs = spread(table(spark, folder, "documents")).select((F.lit(-1) - F.col("doc_id")).alias("run_id"), "text")
    return _responses(spark, folder).unionByName(plain_docs).select(
        "run_id", text.has_citation(F.col("text"), K.CITATION_STYLES).alias("cited"), text.has_citation(F.col("text")).alias("marked")
    )


def _context(spark, folder):
    """Retrieved records in retrieval order: published rows, some without an id or source."""
    g = views.gold(spark, folder)
    rid = F.col("record_id")
    return g.select(
        rid.alias("position"),
        F.when(rid % 3 != 0, F.floor(rid / 2)).alias("record_id"),
        F.when(rid % 7 == 0, "news").otherwise("gold").alias("type"),
        F.when(rid % 5 != 0, F.col("source_code")).alias("source_name"),
        "indicator_code", "country_code", "period",
        F.when(rid % 7 == 0, F.col("region")).alias("title"),
    )


_CTX = """ctx AS (SELECT record_id AS position, CASE WHEN record_id % 3 <> 0 THEN record_id // 2 END AS record_id, CASE WHEN record_id % 7 = 0 THEN 'news' ELSE 'gold' END AS type,
    CASE WHEN record_id % 5 <> 0 THEN source_code END AS source_name, indicator_code, country_code, period, CASE WHEN record_id % 7 = 0 THEN region END AS title FROM v_gold)"""


@query("context_records_unique", uses=["gold"], sql=f"""
  WITH {_CTX} SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN record_id IS NOT NULL THEN 'id|' || CAST(record_id AS VARCHAR)
    ELSE 'k|' || type || '|' || coalesce(source_name, '~') || '|' || indicator_code || '|' || country_code || '|' || period || '|' || coalesce(title, '~') END ORDER BY position) AS k FROM ctx) WHERE k = 1""")
def context_records_unique(spark, folder):
    return R.unique_records(_context(spark, folder), "position")


@query("citations_dedupe", uses=["gold"], sql=f"""
  WITH {_CTX} SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY source_name, indicator_code, country_code, period, title ORDER BY position) AS k
    FROM ctx WHERE source_name IS NOT NULL) WHERE k = 1""")
def citations_dedupe(spark, folder):
    return R.bibliography(_context(spark, folder), "position")


@query("chat_last_n", uses=["messages"], sql="""
  SELECT session_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS k FROM v_messages) WHERE k <= 6""")
def chat_last_n(spark, folder):
    return R.last_messages(views.messages(spark, folder)).select("session_id", "turn", "role", "text")


@query("chat_user_messages", uses=["sessions"], sql="""
  SELECT m.session_id, m.turn, m.role FROM v_messages m JOIN v_sessions s ON m.session_id = s.session_id WHERE s.user_id = 7 AND s.session_id % 3 = 1""")
def chat_user_messages(spark, folder):
    """Every third session belongs to the tenant that asks."""
    sessions = views.sessions(spark, folder).withColumn("tenant_id", F.col("session_id") % 3)
    return R.session_messages(views.messages(spark, folder), sessions, 7, 1).select("session_id", "turn", "role")


@query("run_trace", uses=["messages"], sql="""
  SELECT session_id AS run_id, turn // 64 AS block, string_agg(CAST(turn AS VARCHAR) || ':' || role, ',' ORDER BY turn) AS steps, count(*) AS n_steps FROM v_messages GROUP BY ALL""")
def run_trace(spark, folder):
    steps = views.messages(spark, folder).select(
        F.col("session_id").alias("run_id"), F.col("turn").alias("step_index"), F.col("role").alias("step_type"), F.col("text").alias("payload")
    )
    return R.run_traces(steps).select(
        "run_id", "block",
        F.array_join(F.transform("steps", lambda s: F.concat(s["step_index"].cast("string"), F.lit(":"), s["step_type"])), ",").alias("steps"),
        F.size("steps").cast("bigint").alias("n_steps"),
    )
