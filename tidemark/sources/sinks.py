"""Writers: append, upsert, replace-partition, CSV and JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.medallion import stable_id
from tidemark.session import materialise


def append_bronze(raw: DataFrame, path: str, crawled_at: Column, run: str) -> None:
    """Raw observations stamped with crawl time and one request id per run, split by source and crawl date."""
    raw.withColumn("crawled_at", crawled_at).withColumn("crawl_date", F.col("crawled_at").cast("date")).withColumn(
        "request_id", stable_id(F.lit("run"), F.lit(run))
    ).hint("rebalance", "source_code", "crawl_date").write.mode("append").partitionBy("source_code", "crawl_date").parquet(path)


def write_routed(spark: SparkSession, silver: DataFrame, path: str) -> dict[str, DataFrame]:
    """Scored rows written once, split by routing status; each route reads back only its own part."""
    silver.write.mode("errorifexists").partitionBy("dq_status").parquet(path)
    whole = spark.read.parquet(path)
    return {s: whole.filter(F.col("dq_status") == s) for s in ("AUTO_PROMOTED", "REVIEW", "REJECTED")}


def merge_by_key(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert as a frame: incoming rows replace current rows with the same key."""
    kept = current.join(incoming.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(incoming)


def upsert_partitions(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], partition: str) -> None:
    """Upsert into a table partitioned by ``partition``, one of the keys: only partitions with incoming rows are rewritten."""
    touched = incoming.select(partition).distinct()
    current = spark.read.parquet(path).select(*incoming.columns).join(touched, partition, "left_semi")
    merged = materialise(spark, merge_by_key(current.select(*incoming.columns), incoming, keys), "upsert")
    replace_partitions(merged, path, [partition])


def replace_partitions(df: DataFrame, path: str, columns: list[str]) -> None:
    """Overwrite only the partitions present in ``df``."""
    df.hint("rebalance", *columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
