"""Sinks written and read back: what was stored is what the check computes."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tidemark.functions.numeric import rnd
from tidemark.plans import governance, trend
from tidemark.plans import sqlviews as V
from tidemark.plans.catalog import CATALOG, query
from tidemark.session import fresh_path
from tidemark.sources import sinks, views

AS_OF = partial(views.clock, views.AS_OF_EVENTS)


@query("bronze_store", uses=["bronze"], sql="""
  SELECT source_code, CAST(crawled_at AS DATE) AS crawl_date, 2 * count(*) AS n, count(raw_value) AS n_values, 2 AS n_runs FROM v_bronze GROUP BY ALL""")
def bronze_store(spark, folder):
    """Two runs land in the same store, the second without values."""
    path = fresh_path(spark, "bronze-store")
    rows = views.bronze(spark, folder)
    sinks.append_bronze(rows, path, F.col("crawled_at"), "first")
    sinks.append_bronze(rows.withColumn("raw_value", F.lit(None).cast("string")), path, F.col("crawled_at"), "second")
    return spark.read.parquet(path).groupBy("source_code", "crawl_date").agg(
        F.count(F.lit(1)).alias("n"), F.count("raw_value").alias("n_values"), F.count_distinct("request_id").alias("n_runs")
    )


_EXPORT = "SELECT record_id, indicator_code, country_code, period, value FROM v_gold WHERE period >= '1997'"


def _export(spark, folder):
    return views.gold(spark, folder).filter(F.col("period") >= "1997").select("record_id", "indicator_code", "country_code", "period", "value")


@query("export_csv", uses=["gold"], sql=f"SELECT * REPLACE ({V.rnd('value', 6)} AS value) FROM ({_EXPORT})")
def export_csv(spark, folder):
    rows, path = _export(spark, folder), fresh_path(spark, "export-csv")
    sinks.export_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path).withColumn("value", rnd("value", 6))


@query("export_json", uses=["gold"], sql=f"SELECT * REPLACE ({V.rnd('value', 6)} AS value) FROM ({_EXPORT})")
def export_json(spark, folder):
    rows, path = _export(spark, folder), fresh_path(spark, "export-json")
    sinks.export_json(rows, path)
    return spark.read.schema(rows.schema).json(path).withColumn("value", rnd("value", 6))


@query("scorecard_store", sql=CATALOG["scorecard_upsert"].sql)
def scorecard_store(spark, folder):
    """Cards stored by week; recomputed recent weeks are upserted, older partitions stay untouched."""
    path = fresh_path(spark, "scorecards")
    cards = governance._cards(spark, folder).select("source_code", "week_start", "source_reputation_score")
    cards.hint("rebalance", "week_start").write.partitionBy("week_start").parquet(path)
    recent = cards.filter(F.col("week_start") >= F.lit("2001-01-01").cast("date")).withColumn("source_reputation_score", F.lit(100.0))
    sinks.upsert_partitions(spark, path, recent, ["source_code", "week_start"], "week_start")
    return spark.read.schema(cards.schema).parquet(path)


@query("forecast_store", sql=CATALOG["forecast_trend"].sql)
def forecast_store(spark, folder):
    """Forecasts replace those of the same indicator in the store."""
    path = fresh_path(spark, "forecasts")
    rows = trend.forecast_trend(spark, folder)
    stale = rows.withColumn(rows.columns[-1], F.lit(None).cast(rows.schema[rows.columns[-1]].dataType))
    sinks.replace_partitions(stale, path, ["indicator_code"])
    sinks.replace_partitions(rows, path, ["indicator_code"])
    return spark.read.schema(rows.schema).parquet(path)
