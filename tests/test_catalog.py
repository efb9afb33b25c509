"""Registered queries: contract, agreement with DuckDB, streams against their batch twins."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_parity import TABLES, rows_of

CATALOG = entry.queries()
CHECKS = entry.oracle_sql()


def test_contract(spark):
    assert set(CHECKS) <= set(CATALOG)
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["source_code", "dq_status", "n", "avg_dq"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_duckdb(spark, sf, duck, name):
    df = CATALOG[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    cur = duck.execute(CHECKS[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cur.fetchall())


def test_tools(spark, sf):
    from tidemark.plans import tools
    from tidemark.sources import views
    from tidemark.sources.tables import table

    tables = {"gold": views.gold(spark, sf), "news": views.news(spark, sf), "vectors": table(spark, sf, "embeddings")}
    known = tables["gold"].filter("tenant_id IS NULL AND NOT is_forecast").first()
    args = {"indicator_code": known.indicator_code.lower(), "country_code": known.country_code.lower()}
    assert tools.run("get_indicator_timeseries", tables, **args).count() > 0
    assert tools.run("compare_countries", tables, indicator_code=args["indicator_code"], countries=[args["country_code"]]).count() == 1
    assert tools.run("search_gold_records", tables, query=[0.0] * 64).count() == 6
    assert tools.run("search_news", tables, query="the").count() == 5
    with pytest.raises(ValueError):
        tools.run("get_forecast", tables, indicator_code="GDP_GROWTH")
    with pytest.raises(ValueError):
        tools.run("search_news", tables, query="the", pages=2)
    with pytest.raises(KeyError):
        tools.run("nope", tables)


def test_medallion_stream_reads_only_new_files(spark, sf):
    from tidemark.plans.streams import AS_OF
    from tidemark.session import fresh_path
    from tidemark.sources.tables import table
    from tidemark.streaming import jobs

    landing, out = fresh_path(spark, "landing"), fresh_path(spark, "out")
    events = table(spark, sf, "events")
    for part in ("event_id < 400", "event_id >= 400"):
        events.filter(part).write.mode("append").parquet(landing)
        jobs.medallion(spark, landing, AS_OF(), out)
    silver = spark.read.parquet(f"{out}/silver")
    assert silver.count() == events.count() == silver.select("record_id").distinct().count()
    assert silver.select("batch").distinct().count() == 2
