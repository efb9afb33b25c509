"""Landed payload and page queries. Payloads are built from the published series by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.numeric import rnd
from tidemark.plans import sqlviews as V
from tidemark.plans.catalog import query
from tidemark.sources import landed as L
from tidemark.sources import views
from tidemark.sources.tables import spread, table

_ANNUAL = "an AS (SELECT indicator_code, country_code, period, CAST(floor(CAST(sum(cents) AS BIGINT) / count(*)) AS BIGINT) AS c FROM v_gold GROUP BY ALL)"
_UNIT = V.case_map("indicator_code", {k: v[2] for k, v in K.INDICATORS.items()})


def _annual(spark, folder):
    return views.gold(spark, folder).groupBy("indicator_code", "country_code", "period").agg(
        F.floor(F.sum("cents") / F.count(F.lit(1))).alias("c")
    )


def _shown(df):
    return df.select("indicator_code", "country_code", "period", rnd(F.col("raw_value").try_cast("double"), 6).alias("value"), "raw_unit")


def _paged_payloads(spark, folder):
    """``[meta, entries]`` documents per indicator and country (entries: one per year)."""
    c = F.col("c")
    entry = F.struct(
        F.when(c % 11 != 0, F.col("period")).otherwise("").alias("date"), F.when(c % 7 != 0, c).alias("value")
    )
    return _annual(spark, folder).groupBy("indicator_code", "country_code").agg(F.to_json(F.collect_list(entry)).alias("_e")).select(
        "indicator_code", "country_code", F.concat(F.lit('[{"page":1,"per_page":100},'), "_e", F.lit("]")).alias("payload")
    )


_PAGED = f"""SELECT indicator_code, country_code, period, {V.rnd("c * CASE indicator_code WHEN 'GDP_CURRENT_USD' THEN 1e-9 WHEN 'POPULATION' THEN 1e-6 ELSE 1e0 END", 6)} AS value,
    {_UNIT} AS raw_unit FROM an WHERE c % 7 <> 0 AND c % 11 <> 0"""


@query("json_flatten_paged", uses=["gold"], sql=f"WITH {_ANNUAL} {_PAGED}")
def json_flatten_paged(spark, folder):
    return _shown(L.paged_observations(_paged_payloads(spark, folder)))


def _nested_payloads(spark, folder):
    """``values[code][country][year]`` documents per indicator."""
    code = F.create_map(*[F.lit(x) for pair in K.IMF_CODES.items() for x in pair])[F.col("indicator_code")]
    years = _annual(spark, folder).groupBy("indicator_code", "country_code").agg(
        F.map_from_entries(F.collect_list(F.struct("period", F.when(F.col("c") % 7 != 0, F.col("c").cast("double"))))).alias("y")
    )
    countries = years.groupBy("indicator_code").agg(F.map_from_entries(F.collect_list(F.struct("country_code", "y"))).alias("m"))
    return countries.select(F.to_json(
        F.struct(F.create_map(code, F.col("m")).alias("values")), {"ignoreNullFields": "false"}).alias("payload"))


def _tracked(spark, folder):
    return table(spark, folder, "nation").filter(F.col("n_regionkey") != 2).select(F.col("n_name").alias("country_code"))


_NESTED = f"""SELECT indicator_code, country_code, period, {V.rnd('CAST(c AS DOUBLE)', 6)} AS value, {_UNIT} AS raw_unit FROM an
  WHERE c % 7 <> 0 AND CAST(period AS INT) >= 1997 AND country_code IN (SELECT n_name FROM nation WHERE n_regionkey <> 2)"""


@query("json_flatten_nested", uses=["gold"], sql=f"WITH {_ANNUAL} {_NESTED}")
def json_flatten_nested(spark, folder):
    back = {v: k for k, v in K.IMF_CODES.items()}
    return _shown(L.nested_map_observations(_nested_payloads(spark, folder), _tracked(spark, folder), back, 1997))


def _list_payloads(spark, folder):
    """``observations`` documents per indicator for one country; missing values are dots."""
    c = F.col("c")
    entry = F.struct(
        F.concat("period", F.lit("-01-01")).alias("date"),
        F.when(c % 7 == 0, ".").when(c % 11 == 0, "").otherwise(c.cast("string")).alias("value"),
    )
    one = _annual(spark, folder).filter(F.col("country_code") == "NATION_1")
    return one.groupBy("indicator_code").agg(F.collect_list(entry).alias("observations")).select(
        "indicator_code", F.to_json(F.struct("observations")).alias("payload")
    )


_LIST = f"""SELECT indicator_code, 'USA' AS country_code, period, {V.rnd('CAST(c AS DOUBLE)', 6)} AS value, {_UNIT} AS raw_unit FROM an
  WHERE country_code = 'NATION_1' AND c % 7 <> 0 AND c % 11 <> 0"""


@query("json_flatten_observations", uses=["gold"], sql=f"WITH {_ANNUAL} {_LIST}")
def json_flatten_observations(spark, folder):
    return _shown(L.observation_list(_list_payloads(spark, folder)))


@query("source_union", uses=["gold"], sql=f"""
  WITH {_ANNUAL}, u AS (SELECT 'WORLD_BANK' AS source_code, * FROM ({_PAGED}) UNION ALL SELECT 'IMF', * FROM ({_NESTED}) UNION ALL SELECT 'FRED', * FROM ({_LIST}))
  SELECT source_code, indicator_code, count(*) AS n, {V.rnd('sum(value)', 3)} AS total FROM u GROUP BY ALL""")
def source_union(spark, folder):
    back = {v: k for k, v in K.IMF_CODES.items()}
    raw = L.source_union({
        "WORLD_BANK": L.paged_observations(_paged_payloads(spark, folder)),
        "IMF": L.nested_map_observations(_nested_payloads(spark, folder), _tracked(spark, folder), back, 1997),
        "FRED": L.observation_list(_list_payloads(spark, folder)),
    })
    value = rnd(F.col("raw_value").try_cast("double"), 6)
    return raw.groupBy("source_code", "indicator_code").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum(value), 3).alias("total"))


@query("extraction_filter", sql=f"""
  WITH e AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS v FROM events)
  SELECT event_id, 'CPI_INFLATION' AS indicator_code, CAST(v AS DOUBLE) AS value, (event_id % 10) / 10e0 AS confidence FROM e WHERE event_id % 10 >= 4
  UNION ALL SELECT event_id, 'GDP_GROWTH', CAST(v + 1 AS DOUBLE), NULL FROM e""")
def extraction_filter(spark, folder):
    """Model output documents of every event: an object around the list, sometimes the bare list."""
    v = F.round(F.col("value") * 100).cast("bigint")
    first = F.struct(F.lit("CPI_INFLATION").alias("indicator_code"), v.alias("value"), (F.col("event_id") % 10 / 10).alias("confidence"))
    second = F.struct(F.lit("GDP_GROWTH").alias("indicator_code"), (v + 1).alias("value"), F.lit(None).cast("double").alias("confidence"))
    rows = F.array(first, second)
    payload = F.when(F.col("event_id") % 13 == 0, F.to_json(rows)).otherwise(
        F.to_json(F.struct(F.lit("found two").alias("note"), rows.alias("records")))
    )
    docs = table(spark, folder, "events").select("event_id", payload.alias("payload"))
    return L.extracted_records(docs, "event_id").select("event_id", "indicator_code", "value", "confidence")


@query("page_text", sql=f"""
  SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, {V.q(K.SCRIPT_BLOCK)}, ' ', 'g'), '{K.TAG}', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages""")
def page_text(spark, folder):
    return spread(table(spark, folder, "pages")).select("page_id", L.page_text(F.col("html")).alias("text"))


def _links_sql(patterns: list[str]) -> str:
    wanted = " OR ".join(f"regexp_matches(url, {V.q(p)})" for p in patterns)
    return f"""
  WITH a AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS base, unnest(regexp_extract_all(html, {V.q(K.ANCHOR)}, 1)) AS href,
      unnest(regexp_extract_all(html, {V.q(K.ANCHOR)}, 2)) AS body, unnest(range(len(regexp_extract_all(html, {V.q(K.ANCHOR)})))) AS pos FROM pages),
  l AS (SELECT page_id, pos, CASE WHEN href LIKE 'http%' THEN href ELSE base || href END AS url,
      trim(regexp_replace(regexp_replace(body, '{K.TAG}', '', 'g'), '\\s+', ' ', 'g')) AS title FROM a),
  f AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS k FROM l WHERE length(title) >= 8 AND ({wanted})),
  r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM f WHERE k = 1)
  SELECT page_id, CAST(rank AS INT) AS rank, url, substr(title, 1, 120) AS title FROM r WHERE rank <= 25"""


@query("page_links", sql=_links_sql(["/[A-Za-z]"]))
def page_links(spark, folder):
    """Links whose path starts with a plain letter (the sample pages hold no article urls)."""
    return L.page_links(spread(table(spark, folder, "pages")), ["/[A-Za-z]"])


@query("page_article_links", sql=_links_sql(K.ARTICLE_URLS))
def page_article_links(spark, folder):
    return L.page_links(spread(table(spark, folder, "pages")))
