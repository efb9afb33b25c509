"""The engine's logical tables laid over the driver's Parquet tables.

Each function is one projection (plus dimension joins) of a physical table, so
filters and column pruning reach the Parquet scan. Clock values are literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import parsing
from tidemark.functions.numeric import lookup
from tidemark.operators import keyed
from tidemark.sources.tables import spread, table

AS_OF_EVENTS = "2024-02-01 00:00:00"
AS_OF_ORDERS = "2001-08-02 00:00:00"


def clock(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _pick(index: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, ts)


def bronze(spark: SparkSession, folder: str) -> DataFrame:
    return bronze_from(spread(table(spark, folder, "events")))


def bronze_from(e: DataFrame) -> DataFrame:
    """Raw observations from event rows; also used on the event stream."""
    eid, uid, y, v = F.col("event_id"), F.col("user_id"), F.col("_y"), F.col("_v")
    cents = F.col("_cents")
    e = (
        e.withColumns({
            "_y": (F.lit(2024) - eid % 9).cast("string"),
            "_cents": F.round(F.col("value") * 100).cast("bigint"),
        })
        .withColumn(
            "_v",
            F.concat(F.floor(cents / 1000).cast("string"), F.lit("."), F.lpad((cents % 1000).cast("string"), 3, "0")),
        )
    )
    indicator = F.when(
        eid % 97 != 0,
        lookup(F.col("event_type"), {
            "click": "GDP_GROWTH", "view": "CPI_INFLATION", "signup": "UNEMPLOYMENT_RATE",
            "purchase": "GDP_CURRENT_USD", "error": "POPULATION",
        }),
    )
    period = (
        F.when(eid % 5 <= 1, y)
        .when(eid % 5 == 2, F.concat(y, F.lit("-Q"), (eid % 4 + 1).cast("string")))
        .when(eid % 5 == 3, F.concat(y, F.lit("-"), F.lpad((eid % 12 + 1).cast("string"), 2, "0")))
        .when(eid % 35 == 4, F.lit("latest"))
        .otherwise(F.concat(y, F.lit("-06-01")))
    )
    shape = eid % 12
    raw_value = (
        F.when(shape <= 4, v)
        .when(shape == 5, F.concat(v, F.lit("%")))
        .when(shape == 6, F.concat(F.lit("$"), v, F.lit("T")))
        .when(shape == 7, F.concat(v, F.lit("B")))
        .when(shape == 8, F.concat(v, F.lit(" million")))
        .when(shape == 9, F.concat(v, F.lit("% (forecast)")))
        .when(eid % 24 == 10, F.lit("N/A"))
        .when(shape == 10, F.concat(v, F.lit(" percent")))
        .when(eid % 36 == 23, F.lit(""))
        .when(eid % 36 == 35, F.lit(".."))
    )
    tenant = uid % 4
    base = e.select(
        eid.alias("record_id"),
        F.when(tenant != 0, tenant).alias("tenant_id"),
        _pick(eid % 3, ["WORLD_BANK", "IMF_WEO", "FRED"]).alias("source_code"),
        indicator.alias("indicator_code"),
        _pick(uid % 20, K.COUNTRIES).alias("country_code"),
        period.alias("period"),
        raw_value.alias("raw_value"),
        F.timestamp_add("DAY", -(eid % 120), F.col("ts").cast("timestamp_ntz")).alias("crawled_at"),
        F.concat(F.lit("https://example.org/"), eid.cast("string")).alias("source_url"),
    )
    unit = parsing.standard_unit(F.col("indicator_code"))
    raw_unit = F.col("record_id") % 6
    return base.withColumn("standard_unit", unit).withColumn(
        "raw_unit",
        F.when(raw_unit == 0, "percent").when(raw_unit == 1, "%").when(raw_unit == 2, "USD billions")
        .when(raw_unit == 3, F.col("standard_unit")).when(raw_unit == 5, "index"),
    )


_DIGIT_INDICATOR = {
    1: ("GDP_GROWTH", "PCT"), 2: ("CPI_INFLATION", "PCT"), 3: ("UNEMPLOYMENT_RATE", "PCT"),
    4: ("GOVT_DEBT_PCT_GDP", "PCT_GDP"), 5: ("GDP_CURRENT_USD", "USD_BN"),
}
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def value_from_cents(cents: Column, digit: Column) -> Column:
    return (
        F.when(digit <= 3, (cents - 25000000) / F.lit(1e6))
        .when(digit == 4, cents / F.lit(250000.0))
        .otherwise(cents / F.lit(100000.0))
    )


def gold(spark: SparkSession, folder: str) -> DataFrame:
    """Published records: many rows per (indicator, country, period), as revisions arrive."""
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    dq = (F.lit(60) + key % 41).cast("double")
    tenant = cust % 4
    segments = keyed.sql_ranks("c_mktsegment", _SEGMENTS)
    day = F.col("o_orderdate").cast("timestamp_ntz")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("digit", digit)
        .withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
        .select(
            key.alias("record_id"),
            F.when(tenant != 0, tenant).alias("tenant_id"),
            key.alias("silver_id"),
            _pick(F.col("digit") - 1, [v[0] for v in _DIGIT_INDICATOR.values()]).alias("indicator_code"),
            F.col("n_name").alias("country_code"),
            F.col("r_name").alias("region"),
            F.year("o_orderdate").cast("string").alias("period"),
            F.concat(
                F.year("o_orderdate").cast("string"), F.lit("-Q"), F.quarter("o_orderdate").cast("string")
            ).alias("period_q"),
            "digit",
            "cents",
            value_from_cents(F.col("cents"), F.col("digit")).alias("value"),
            _pick(F.col("digit") - 1, [v[1] for v in _DIGIT_INDICATOR.values()]).alias("standard_unit"),
            F.col("c_mktsegment").alias("source_code"),
            (F.lit(80.0) + segments * 3).alias("reliability"),
            day.alias("crawled_at"),
            _plus_seconds(day, key % 86400).alias("promoted_at"),
            dq.alias("dq_score"),
            (key % 10 == 0).alias("is_forecast"),
            F.when(dq < 90, F.concat(F.lit("analyst"), (cust % 3).cast("string")))
            .otherwise(F.lit("auto")).alias("approved_by"),
            cust.alias("customer_id"),
        )
    )


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Competing source values per key: each source's latest promotion."""
    g = gold(spark, folder)
    step = _pick(F.col("digit") - 1, [0.02, 0.05, 0.1, 0.3, 1.0])
    g = g.withColumn("value", F.lit(100.0) + (F.col("record_id") % 13) * step)
    return keyed.latest(
        g, ["indicator_code", "country_code", "period", "source_code"],
        [F.col("promoted_at"), F.col("record_id")],
        ["record_id", "value", "reliability", "crawled_at", "dq_score", "silver_id"],
    )


def series(spark: SparkSession, folder: str) -> DataFrame:
    """Quarterly series per (indicator, country): exact integer mean, so order-free."""
    g = gold(spark, folder).filter(~F.col("is_forecast"))
    mean_cents = F.sum("cents") / F.count(F.lit(1))
    return (
        g.groupBy("indicator_code", "country_code", "digit", F.col("period_q").alias("period"))
        .agg(mean_cents.alias("mean_cents"), F.max("dq_score").alias("dq_score"))
        .withColumn("value", value_from_cents(F.col("mean_cents"), F.col("digit")))
        .select("indicator_code", "country_code", "period", "value", "dq_score")
    )


def supply(spark: SparkSession, folder: str) -> DataFrame:
    """Per-source activity facts for scorecards and costs."""
    line = F.col("l_linenumber")
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("source_code"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("crawled_at"),
        F.when(F.col("l_orderkey") % 11 != 0, F.col("l_orderkey")).alias("raw_value"),
        (F.lit(60) + F.col("l_partkey") % 41).alias("dq_score"),
        F.when(F.col("l_returnflag") == "N", "ROUTINE").when(F.col("l_returnflag") == "A", "MODERATE")
        .otherwise("MAJOR").alias("severity"),
        ((F.col("l_linestatus") == "F") & (line == 1)).alias("is_revision"),
        _pick(line % 4, ["groq", "gemini", "openrouter", "cerebras"]).alias("provider"),
        (F.col("l_quantity").cast("bigint") * 100).alias("tokens"),
    )


def supply_sources(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("source_code"),
        F.col("s_acctbal").alias("reputation"),
        (F.col("s_suppkey") % 5 == 0).alias("has_error"),
        (F.col("s_suppkey") % 7 != 0).alias("is_active"),
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations")
    return c.select(
        F.col("conv_id").alias("session_id"), F.col("turn"), F.col("role"), F.col("text"),
        (F.col("conv_id") % 60).alias("user_id"),
        F.when(F.col("turn") <= 1, F.array(F.col("conv_id") * 7 + F.col("turn"))).alias("record_ids"),
    )


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    return messages(spark, folder).groupBy("session_id", "user_id").agg(
        F.max("turn").alias("last_active"), F.count(F.lit(1)).alias("n_messages")
    )


def exchanges(spark: SparkSession, folder: str) -> DataFrame:
    """(user text, following assistant text): turns are consecutive, so an equi-join on turn + 1."""
    m = messages(spark, folder)
    q = m.filter(F.col("role") == "user").select(
        "session_id", "turn", F.col("text").alias("query"), (F.col("turn") + 1).alias("next_turn")
    )
    a = m.filter(F.col("role") == "assistant").select(
        F.col("session_id").alias("a_session"), F.col("turn").alias("a_turn"), F.col("text").alias("response")
    )
    return q.join(
        a, (F.col("session_id") == F.col("a_session")) & (F.col("next_turn") == F.col("a_turn"))
    ).select("session_id", "turn", "query", "response")


def news(spark: SparkSession, folder: str) -> DataFrame:
    did = F.col("doc_id")
    return spread(table(spark, folder, "documents")).select(
        did.alias("news_id"),
        F.when(did % 4 != 0, did % 4).alias("tenant_id"),
        F.substring("text", 1, 80).alias("title"),
        F.col("text").alias("content"),
        F.col("source").alias("source_name"),
        _pick(did % 20, K.COUNTRIES).alias("country_code"),
        F.when(did % 11 != 0, F.timestamp_add("DAY", did % 30, clock("2024-01-01 00:00:00"))).alias("published_at"),
    )


def hits(spark: SparkSession, folder: str) -> DataFrame:
    return hits_from(table(spark, folder, "events"))


def hits_from(e: DataFrame) -> DataFrame:
    """API hits of the users: an event is followed by up to eleven more hits, 7 to 25 seconds apart."""
    burst = e.select("*", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 12).cast("int"))).alias("_n"))
    gap = F.col("_n") * (F.col("event_id") % 19 + 7)
    return burst.select(
        (F.col("event_id") * 12 + F.col("_n")).alias("hit_id"),
        F.col("user_id").alias("identifier"),
        _pick(F.col("user_id") % 3, ["PUBLIC", "EXTERNAL_BUSINESS", "ADMIN"]).alias("role"),
        F.timestamp_add("SECOND", gap, F.col("ts").cast("timestamp_ntz")).alias("hit_at"),
    )


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    return blocks_from(table(spark, folder, "events"))


def blocks_from(e: DataFrame) -> DataFrame:
    return e.filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("block_id"),
        F.col("user_id").alias("source_url"),
        F.col("ts").cast("timestamp_ntz").alias("blocked_at"),
    )


def crawl_log(spark: SparkSession, folder: str) -> DataFrame:
    return crawl_log_from(table(spark, folder, "events"))


def crawl_log_from(e: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("log_id"),
        F.col("user_id").alias("source_code"),
        F.when(kind.isin("click", "view"), "PROCEED").when(kind == "signup", "SKIP")
        .when(kind == "error", "DEFER").alias("action"),
        F.substring(F.sha2((F.col("event_id") % 3).cast("string"), 256), 1, 16).alias("content_hash"),
        F.col("ts").cast("timestamp_ntz").alias("logged_at"),
    )


def consent_events(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return (
        table(spark, folder, "events").filter(kind.isin("signup", "error")).select(
            F.col("event_id"),
            F.col("user_id"),
            _pick(F.col("event_id") % 3, ["ANALYTICS", "PERSONALIZATION", "MARKETING"]).alias("consent_type"),
            F.when(kind == "signup", "grant").otherwise("revoke").alias("action"),
            F.col("ts").cast("timestamp_ntz").alias("noted_at"),
        )
    )


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    eid = F.col("event_id")
    level = (eid % 4 + 2).cast("int")
    hours = _pick(eid % 4, [K.LEVEL_SLA_HOURS[n] for n in (2, 3, 4, 5)])
    ts = F.col("ts").cast("timestamp_ntz")
    return table(spark, folder, "events").select(
        eid.alias("task_id"),
        F.when(eid % 3 != 0, "PENDING").otherwise("RESOLVED").alias("status"),
        level.alias("level"),
        ts.alias("assigned_at"),
        F.timestamp_add("HOUR", hours, ts).alias("sla_deadline"),
    )


def cost_events(spark: SparkSession, folder: str) -> DataFrame:
    """Metered use: tokens, crawl seconds or bytes, depending on the category."""
    eid = F.col("event_id")
    cents = F.round(F.col("value") * 100).cast("bigint")
    category = _pick(eid % 3, ["LLM", "CRAWLER", "STORAGE"])
    return table(spark, folder, "events").select(
        eid.alias("cost_id"), F.col("user_id").alias("source_id"), category.alias("category"),
        F.when(category == "LLM", _pick(eid % 4, ["groq", "gemini", "openrouter", "cerebras"])).alias("provider"),
        cents.alias("quantity"),
        F.col("ts").cast("timestamp_ntz").alias("occurred_at"),
    )
