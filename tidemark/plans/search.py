"""Search and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.numeric import plain, rnd
from tidemark.operators import evaluation as EV
from tidemark.operators import keyed
from tidemark.operators import published as P
from tidemark.operators import search as S
from tidemark.plans import sqlviews as V
from tidemark.plans.catalog import query
from tidemark.sources import views
from tidemark.sources.tables import table

_CENT = """cent AS (SELECT label, list(m ORDER BY i) AS q FROM (
    SELECT label, i, CAST(sum(CAST(floor(CAST(embedding[i] AS DOUBLE) * 1e9) AS BIGINT)) AS BIGINT) / count(*) / 1e9 AS m
    FROM embeddings, range(1, 65) t(i) GROUP BY ALL) GROUP BY label)"""
_DIST = V.rnd("list_distance(CAST(embedding AS DOUBLE[]), q)", 6)


def _vectors(spark, folder):
    return table(spark, folder, "embeddings")


def _label_queries(spark, folder):
    return S.centroids(_vectors(spark, folder), "label").select(F.col("label").cast("bigint").alias("query_id"), "embedding")


@query("vector_topk", sql=f"""
  WITH {_CENT}, d AS (SELECT c.label AS query_id, vec_id, {_DIST} AS distance FROM cent c, embeddings e),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
  SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INT) AS rank, vec_id, distance FROM r WHERE rank <= 6""")
def vector_topk(spark, folder):
    """Six nearest vectors to each label's mean vector, over all vectors."""
    return S.nearest(_vectors(spark, folder), _label_queries(spark, folder), 6).select(
        "query_id", "rank", "vec_id", "distance"
    )


@query("vector_topk_country", uses=["news"], sql=f"""
  WITH {_CENT}, d AS (SELECT c.label AS query_id, vec_id, {_DIST} AS distance FROM cent c, embeddings JOIN v_news ON vec_id = news_id
    WHERE country_code = 'DEU' AND (tenant_id IS NULL OR tenant_id = 2)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
  SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INT) AS rank, vec_id, distance FROM r WHERE rank <= 5""")
def vector_topk_country(spark, folder):
    pool = P.visible_to(views.news(spark, folder), 2).filter(F.col("country_code") == "DEU").select("news_id")
    vectors = _vectors(spark, folder).join(pool, F.col("vec_id") == F.col("news_id"))
    return S.nearest(vectors, _label_queries(spark, folder), 5).select("query_id", "rank", "vec_id", "distance")


@query("vector_search_one", sql=f"""
  WITH c AS (SELECT list(m ORDER BY i) AS q FROM (SELECT i, CAST(sum(CAST(floor(CAST(embedding[i] AS DOUBLE) * 1e9) AS BIGINT)) AS BIGINT) / count(*) / 1e9 AS m
    FROM embeddings, range(1, 65) t(i) GROUP BY ALL))
  SELECT vec_id, label, {_DIST} AS distance FROM embeddings, c ORDER BY distance, vec_id LIMIT 6""")
def vector_search_one(spark, folder):
    """Six vectors closest to the mean of all of them (the query is one 64-number row)."""
    vectors = _vectors(spark, folder)
    target = S.centroids(vectors.withColumn("_all", F.lit(0)), "_all").first()
    return S.search_one(vectors, target["embedding"], 6).select("vec_id", "label", "distance")


@query("search_fallback", uses=["gold"], sql="""
  SELECT record_id, indicator_code, country_code, promoted_at FROM v_gold WHERE tenant_id IS NULL OR tenant_id = 1
  ORDER BY promoted_at DESC, record_id DESC LIMIT 6""")
def search_fallback(spark, folder):
    return S.newest_records(views.gold(spark, folder), 1).select("record_id", "indicator_code", "country_code", "promoted_at")


@query("news_search", uses=["news"], sql="""
  SELECT news_id, title, source_name, published_at, country_code, substr(content, 1, 300) AS snippet FROM v_news
  WHERE (tenant_id IS NULL OR tenant_id = 1) AND (title ILIKE '%tion%' OR content ILIKE '%tion%')
  ORDER BY published_at DESC NULLS LAST, news_id LIMIT 5""")
def news_search(spark, folder):
    return S.keyword_news(views.news(spark, folder), "Tion", 1)


@query("retrieval_eval", sql=f"""
  WITH {_CENT}, d AS (SELECT c.label AS query_id, e.label, vec_id, {_DIST} AS distance FROM cent c, embeddings e),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d),
  x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS k FROM d WHERE label = query_id),
  s AS (SELECT x.query_id, CASE WHEN x.query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS question_type, count(r.vec_id) AS found, count(*) AS n
    FROM x LEFT JOIN r ON r.query_id = x.query_id AND r.vec_id = x.vec_id AND r.rank <= 6 WHERE k <= 8 GROUP BY ALL)
  SELECT coalesce(question_type, 'ALL') AS question_type, count(*) AS total, {V.rnd('count(*) FILTER (found > 0) / count(*)', 4)} AS hit_rate,
    {V.rnd('avg(found / n)', 4)} AS mean_recall FROM s GROUP BY ROLLUP (question_type)""")
def retrieval_eval(spark, folder):
    """Question per label; expected: the eight members closest to the label's own mean."""
    vectors = _vectors(spark, folder)
    queries = _label_queries(spark, folder)
    own = vectors.withColumn("label", F.col("label").cast("bigint")).join(
        queries.withColumnRenamed("embedding", "_q"), F.col("label") == F.col("query_id")
    ).withColumn("distance", rnd(S.l2(F.col("embedding"), F.col("_q")), 6)).select("query_id", "vec_id", "distance")
    best = keyed.top_per_key(own, ["query_id"], [F.col("distance"), F.col("vec_id")], 8)
    questions = best.groupBy("query_id").agg(F.collect_list("vec_id").alias("expected_ids")).withColumn(
        "question_type", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd")
    )
    return EV.retrieval_rollup(EV.retrieval_scores(questions, S.nearest(vectors, queries, 6), 6))


_AUTH = """auth AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY indicator_code, country_code, period ORDER BY dq_score DESC, promoted_at DESC, record_id) AS rn
    FROM v_gold WHERE period BETWEEN '1995' AND '2024') WHERE rn = 1)"""
_NM = V.case_map("indicator_code", {k: v[0] for k, v in K.INDICATORS.items()})


def _phrase(value: str, unit: str) -> str:
    r = V.rnd(value, 2)
    sign = f"CASE WHEN {r} < 0 THEN '-' ELSE '' END"
    whole = f"format('{{:,}}', CAST(floor(abs({r})) AS BIGINT))"
    cents = f"lpad(CAST(CAST(round((abs({r}) - floor(abs({r}))) * 100) AS BIGINT) AS VARCHAR), 2, '0')"
    number = f"rtrim(rtrim({sign} || {whole} || '.' || {cents}, '0'), '.')"
    return f"{number} || CASE {unit} WHEN 'PCT' THEN '%' WHEN 'PCT_GDP' THEN ' % of GDP' WHEN 'USD_BN' THEN ' billion USD' ELSE ' million' END"


_GT = f"""
  WITH {_AUTH},
  pl AS (SELECT 0 AS kind, indicator_code || '|' || d AS ord, 'point_lookup' AS question_type, 'What was the ' || {_NM} || ' of ' || country_code || ' in ' || period || '?' AS question,
      'numeric' AS answer_kind, value AS expected_value, {_phrase('value', 'standard_unit')} AS expected_answer, indicator_code, period, source_code AS expected_source,
      CAST(record_id AS VARCHAR) AS record_ids
    FROM (SELECT *, row_number() OVER (PARTITION BY indicator_code ORDER BY d) AS rank FROM (SELECT *, md5(indicator_code || '|' || country_code || '|' || period || '|42') AS d FROM auth))
    WHERE rank <= greatest(1, 120 // (SELECT count(DISTINCT indicator_code) FROM auth)) ORDER BY indicator_code, d LIMIT 120),
  dr AS (SELECT *, row_number() OVER (PARTITION BY indicator_code, period ORDER BY md5(indicator_code || '|' || period || '|' || country_code || '|42')) AS k FROM auth),
  cm AS (SELECT 1 AS kind, md5(indicator_code || '|' || period || '|42') AS ord, 'comparison' AS question_type,
      'Which had a higher ' || {_NM} || ' in ' || period || ', ' || ca || ' or ' || cb || '?' AS question, 'categorical' AS answer_kind, CAST(NULL AS DOUBLE) AS expected_value,
      CASE WHEN va > vb THEN ca ELSE cb END AS expected_answer, indicator_code, period, sa AS expected_source, CAST(ra AS VARCHAR) || ',' || CAST(rb AS VARCHAR) AS record_ids
    FROM (SELECT a.indicator_code, a.period, a.country_code AS ca, b.country_code AS cb, a.value AS va, b.value AS vb, a.record_id AS ra, b.record_id AS rb, a.source_code AS sa
      FROM dr a JOIN dr b ON a.indicator_code = b.indicator_code AND a.period = b.period AND a.k = 1 AND b.k = 2 WHERE a.value <> b.value) ORDER BY ord LIMIT 40),
  sp AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY indicator_code, period ORDER BY value DESC, country_code) AS hi,
      row_number() OVER (PARTITION BY indicator_code, period ORDER BY value, country_code) AS lo FROM auth WINDOW w AS (PARTITION BY indicator_code, period)),
  sh AS (SELECT 2 AS kind, md5('superlative_high|' || indicator_code || '|' || period || '|42') AS ord, 'superlative_high' AS question_type,
      'Among the tracked countries, which had the highest ' || {_NM} || ' in ' || period || '?' AS question, 'categorical' AS answer_kind, CAST(NULL AS DOUBLE) AS expected_value,
      country_code AS expected_answer, indicator_code, period, source_code AS expected_source, CAST(record_id AS VARCHAR) AS record_ids FROM sp WHERE hi = 1 AND n >= 3 ORDER BY ord LIMIT 20),
  sl AS (SELECT 3 AS kind, md5('superlative_low|' || indicator_code || '|' || period || '|42') AS ord, 'superlative_low' AS question_type,
      'Among the tracked countries, which had the lowest ' || {_NM} || ' in ' || period || '?' AS question, 'categorical' AS answer_kind, CAST(NULL AS DOUBLE) AS expected_value,
      country_code AS expected_answer, indicator_code, period, source_code AS expected_source, CAST(record_id AS VARCHAR) AS record_ids FROM sp WHERE lo = 1 AND n >= 3 ORDER BY ord LIMIT 20),
  pt AS (SELECT *, CAST(period AS INT) AS y FROM auth),
  en AS (SELECT indicator_code, country_code, count(*) AS n, min(y) AS y0, max(y) AS y1 FROM pt GROUP BY ALL),
  gp AS (SELECT a.indicator_code, a.country_code, min(a.y) AS g FROM pt a JOIN pt b ON a.indicator_code = b.indicator_code AND a.country_code = b.country_code AND b.y = a.y + 5 GROUP BY ALL),
  yy AS (SELECT en.indicator_code, en.country_code, coalesce(g, y0) AS ya, coalesce(g + 5, y1) AS yb FROM en LEFT JOIN gp ON en.indicator_code = gp.indicator_code AND en.country_code = gp.country_code WHERE n >= 2),
  tr AS (SELECT 4 AS kind, md5('trend|' || a.indicator_code || '|' || a.country_code || '|42') AS ord, 'trend' AS question_type,
      'Did the ' || {_NM.replace('indicator_code', 'a.indicator_code')} || ' of ' || a.country_code || ' increase or decrease between ' || CAST(ya AS VARCHAR) || ' and ' || CAST(yb AS VARCHAR) || '?' AS question,
      'direction' AS answer_kind, CAST(NULL AS DOUBLE) AS expected_value, CASE WHEN b.value > a.value THEN 'increased' ELSE 'decreased' END AS expected_answer, a.indicator_code,
      CAST(ya AS VARCHAR) || '/' || CAST(yb AS VARCHAR) AS period, b.source_code AS expected_source, CAST(a.record_id AS VARCHAR) || ',' || CAST(b.record_id AS VARCHAR) AS record_ids
    FROM yy JOIN pt a ON a.indicator_code = yy.indicator_code AND a.country_code = yy.country_code AND a.y = ya
      JOIN pt b ON b.indicator_code = yy.indicator_code AND b.country_code = yy.country_code AND b.y = yb WHERE a.value <> b.value ORDER BY ord LIMIT 40),
  al AS (SELECT * FROM pl UNION ALL SELECT * FROM cm UNION ALL SELECT * FROM sh UNION ALL SELECT * FROM sl UNION ALL SELECT * FROM tr)
  SELECT 'gt-' || lpad(CAST(row_number() OVER (ORDER BY kind, ord) AS VARCHAR), 5, '0') AS id, question_type, question, answer_kind,
    {V.rnd('expected_value', 6)} AS expected_value, expected_answer, indicator_code, period, expected_source, record_ids FROM al"""


@query("ground_truth_items", uses=["gold"], sql=_GT)
def ground_truth_items(spark, folder):
    auth = P.authoritative(views.gold(spark, folder), 1995, 2024)
    return EV.ground_truth(auth).withColumn("expected_value", rnd("expected_value", 6))


_ANSWERS = f"""
  WITH {_AUTH}, lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY indicator_code, country_code, period ORDER BY promoted_at DESC, record_id DESC) AS k FROM v_gold) WHERE k = 1),
  e AS (SELECT a.indicator_code || '|' || a.country_code || '|' || a.period AS id, a.value AS ev, l.value AS rv, a.source_code AS es, l.source_code AS rs,
      'In ' || a.period || ' the reading was ' || {V.plain('l.value')} || ' [Source: ' || l.source_code || ', ' || a.period || ']' AS response
    FROM auth a JOIN lt l ON a.indicator_code = l.indicator_code AND a.country_code = l.country_code AND a.period = l.period),
  n AS (SELECT *, CAST(list_distinct(regexp_extract_all(response, '{K.NUMBER_GROUPED}')) AS VARCHAR[]) AS toks FROM e),
  u AS (SELECT id, es, rs, ev, response, CAST(replace(unnest(toks), ',', '') AS DOUBLE) AS x FROM n),
  v AS (SELECT id, any_value(es) AS es, any_value(rs) AS rs, any_value(response) AS response,
      bool_or(abs(x - ev) <= 0.1::DOUBLE OR abs(x - ev) / greatest(abs(ev), 1e-9) <= 0.02::DOUBLE) AS ok FROM u GROUP BY id),
  s AS (SELECT id, 'point_lookup' AS question_type, ok AS correct, ok AS value_correct, contains(lower(response), lower(es)) AS source_cited FROM v
    UNION ALL SELECT id, 'source', contains(lower(response), lower(es)), NULL, contains(lower(response), lower(es)) FROM v)"""


def _entries(spark, folder):
    """Two questions per key, answered from the newest record of the key."""
    g = views.gold(spark, folder)
    auth = P.authoritative(g, 1995, 2024)
    newest = keyed.latest(g, P.KEY, [F.col("promoted_at"), F.col("record_id")], ["value", "source_code"]).select(
        *P.KEY, F.col("value").alias("_v"), F.col("source_code").alias("_s")
    )
    base = auth.join(newest, P.KEY).select(
        F.concat_ws("|", *P.KEY).alias("id"), F.col("value").alias("expected_value"), F.col("source_code").alias("expected_source"),
        F.concat(F.lit("In "), "period", F.lit(" the reading was "), plain("_v"), F.lit(" [Source: "), "_s", F.lit(", "), "period",
                 F.lit("]")).alias("response"),
        F.lit("").alias("cited_sources"),
    )
    kinds = F.array(
        F.struct(F.lit("point_lookup").alias("question_type"), F.lit("numeric").alias("answer_kind")),
        F.struct(F.lit("source").alias("question_type"), F.lit("categorical").alias("answer_kind")),
    )
    return base.select("*", F.inline(kinds)).withColumn("expected_answer", F.col("expected_source"))


@query("answer_scores", uses=["gold"], sql=_ANSWERS + " SELECT * FROM s")
def answer_scores(spark, folder):
    return EV.score_answers(_entries(spark, folder))


@query("answer_rollup", uses=["gold"], sql=_ANSWERS + f"""
  SELECT coalesce(question_type, 'ALL') AS question_type, count(*) AS total, count(*) FILTER (correct) AS correct,
    {V.rnd('count(*) FILTER (correct) / count(*)', 4)} AS accuracy, {V.rnd('count(*) FILTER (source_cited) / count(*)', 4)} AS source_cited_rate
  FROM s GROUP BY ROLLUP (question_type)""")
def answer_rollup(spark, folder):
    return EV.answer_rollup(EV.score_answers(_entries(spark, folder)))
