"""Named table tools: ``run(name, tables, **params)`` with the defaults of each tool.

``tables`` maps gold, vectors, news, silver, reviews and edges to DataFrames; a tool
uses the ones it needs. New tools register with ``tool``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import rnd
from tidemark.operators import provenance, published, search, trend
from tidemark.plans import sqlviews as V
from tidemark.plans.catalog import query as registered
from tidemark.sources import views


@dataclass(frozen=True)
class Tool:
    name: str
    run: Callable[..., DataFrame]
    required: tuple[str, ...] = ()
    defaults: dict = field(default_factory=dict)


TOOLS: dict[str, Tool] = {}


def tool(name: str, required: tuple[str, ...] = (), **defaults):
    def register(fn):
        TOOLS[name] = Tool(name, fn, required, defaults)
        return fn

    return register


def run(name: str, tables: dict[str, DataFrame], **params) -> DataFrame:
    if name not in TOOLS:
        raise KeyError(f"unknown tool: {name}")
    t = TOOLS[name]
    missing = [p for p in t.required if p not in params]
    if missing:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    unknown = sorted(set(params) - {*t.required, *t.defaults})
    if unknown:
        raise ValueError(f"{name} doesn't take {', '.join(unknown)}")
    return t.run(tables, **{**t.defaults, **params})


@tool("search_gold_records", ("query",), limit=6, tenant=None)
def search_gold_records(tables, query, limit, tenant):
    """Nearest published records to a query vector; newest ones when no record has a vector."""
    gold = published.visible_to(tables["gold"], tenant)
    have = gold.join(tables["vectors"], F.col("record_id") == F.col("vec_id"))
    if have.filter(F.col("embedding").isNotNull()).isEmpty():
        return search.newest_records(tables["gold"], tenant, limit)
    return search.search_one(have, query, limit).drop("embedding", "vec_id")


@tool("get_indicator_timeseries", ("indicator_code", "country_code"), year_from=None, year_to=None, limit=50, tenant=None)
def get_indicator_timeseries(tables, indicator_code, country_code, year_from, year_to, limit, tenant):
    return published.timeseries(tables["gold"], tenant, indicator_code, country_code, year_from, year_to, limit)


@tool("compare_countries", ("indicator_code",), countries=None, period=None, g7=False, tenant=None)
def compare_countries(tables, indicator_code, countries, period, g7, tenant):
    return published.compare(tables["gold"], tenant, indicator_code, countries, period, g7)


@tool("get_forecast", ("indicator_code", "country_code"), periods=4, frequency="ANNUAL", tenant=None)
def get_forecast(tables, indicator_code, country_code, periods, frequency, tenant):
    rows = published.visible_to(tables["gold"], tenant).filter(
        (F.col("indicator_code") == indicator_code.upper()) & (F.col("country_code") == country_code.upper())
        & ~F.col("is_forecast")
    )
    return trend.forecast(rows, periods, frequency)


@tool("search_news", ("query",), limit=5, country_code=None, tenant=None)
def search_news(tables, query, limit, country_code, tenant):
    return search.keyword_news(tables["news"], query, tenant, country_code, limit)


@tool("explain_data_lineage", ("gold_record_id",), tenant=None)
def explain_data_lineage(tables, gold_record_id, tenant):
    one = published.visible_to(tables["gold"], tenant).filter(F.col("record_id") == gold_record_id)
    return provenance.lineage(one, tables["silver"], tables["reviews"], tables["edges"])


_CALLS = {
    "get_indicator_timeseries": {"indicator_code": "CPI_INFLATION", "country_code": "NATION_3"},
    "compare_countries": {"indicator_code": "GDP_GROWTH", "countries": ["nation_1", "NATION_6", "NATION_11"]},
    "get_forecast": {"indicator_code": "cpi_inflation", "country_code": "NATION_3"},
    "search_news": {"query": "Tion"},
}
_SEEN = "(tenant_id IS NULL OR tenant_id = 1)"


@registered("tool_answers", uses=["gold", "news"], sql=f"""
  WITH s AS (SELECT * FROM v_gold WHERE {_SEEN} AND indicator_code = 'CPI_INFLATION' AND country_code = 'NATION_3' AND NOT is_forecast),
  c AS (SELECT *, row_number() OVER (PARTITION BY country_code ORDER BY period DESC, record_id) AS rn FROM v_gold
    WHERE {_SEEN} AND indicator_code = 'GDP_GROWTH' AND country_code IN ('NATION_1', 'NATION_6', 'NATION_11') AND NOT is_forecast),
  y AS (SELECT CAST(period AS INT) AS x, value FROM s),
  f AS (SELECT max(x) AS last, regr_slope(value, x - 1990) AS b, regr_intercept(value, x - 1990) AS a FROM y HAVING count(*) >= 5)
  SELECT 'get_indicator_timeseries' AS tool, record_id AS item_id, country_code, period, {V.rnd('value', 4)} AS value
    FROM (SELECT * FROM s ORDER BY period, record_id LIMIT 50)
  UNION ALL SELECT 'compare_countries', record_id, country_code, period, {V.rnd('value', 4)} FROM c WHERE rn = 1
  UNION ALL SELECT 'get_forecast', NULL, 'NATION_3', CAST(last + step AS VARCHAR), {V.rnd('a + b * (last + step - 1990)', 4)}
    FROM f, (SELECT unnest([1, 2, 3, 4]) AS step) WHERE b IS NOT NULL
  UNION ALL SELECT 'search_news', news_id, NULL, NULL, NULL FROM (SELECT news_id FROM v_news
    WHERE {_SEEN} AND (title ILIKE '%tion%' OR content ILIKE '%tion%') ORDER BY published_at DESC NULLS LAST, news_id LIMIT 5)""")
def tool_answers(spark, folder):
    """What four tools, called by name for one tenant, answer."""
    tables = {"gold": views.gold(spark, folder), "news": views.news(spark, folder)}

    def answer(name, params):
        out = run(name, tables, **params, tenant=1)
        item = next((c for c in ("record_id", "news_id") if c in out.columns), None)
        news = name == "search_news"
        return out.select(
            F.lit(name).alias("tool"), (F.col(item) if item else F.lit(None)).cast("bigint").alias("item_id"),
            *[(F.lit(None) if news else F.col(c)).cast("string").alias(c) for c in ("country_code", "period")],
            (F.lit(None).cast("double") if news else rnd("value", 4)).alias("value"),
        )

    return reduce(DataFrame.unionByName, [answer(name, params) for name, params in _CALLS.items()])
