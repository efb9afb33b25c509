"""Readers for the Parquet tables and small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark import constants as K


# Column types of the tables, so that reading needs no inference job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan out to ``tidemark.scan.partitions`` tasks, if the session sets that.

    For small or unsplittable files that feed CPU-heavy row work. Nothing is shuffled unless
    asked for.
    """
    n = df.sparkSession.conf.get("tidemark.scan.partitions", None)
    return df.repartition(int(n)) if n else df


def _dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def indicator_dim(spark: SparkSession) -> DataFrame:
    rows = [(code, *meta) for code, meta in K.INDICATORS.items()]
    return _dimension(
        spark, rows,
        "indicator_code string, indicator_name string, category string, standard_unit string, frequency string",
    )


def source_dim(spark: SparkSession) -> DataFrame:
    rows = [(*s, True) for s in K.SOURCES]
    return _dimension(
        spark, rows,
        "source_code string, source_name string, source_url string, source_type string, "
        "reputation double, is_active boolean",
    )


def country_dim(spark: SparkSession) -> DataFrame:
    rows = [(c, K.COUNTRY_NAMES[c], K.COUNTRY_REGIONS[c]) for c in K.COUNTRIES]
    return _dimension(spark, rows, "country_code string, country_name string, region string")


def multiplier_dim(spark: SparkSession) -> DataFrame:
    rows = [(s, i, m) for (s, i), m in K.SOURCE_MULTIPLIERS.items()]
    return _dimension(spark, rows, "source_family string, indicator_code string, multiplier double")
