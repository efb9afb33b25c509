"""Reads over published (Gold) records: scans, series, comparisons, overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import periods, text
from tidemark.functions.numeric import plain, rnd
from tidemark.operators import keyed

KEY = ["indicator_code", "country_code", "period"]


def visible_to(df: DataFrame, tenant: int | None) -> DataFrame:
    """Global rows plus the tenant's own; without a tenant only global rows."""
    own = F.col("tenant_id").isNull()
    if tenant is not None:
        own = own | (F.col("tenant_id") == tenant)
    return df.filter(own)


def owned_by(df: DataFrame, tenant: int | None) -> DataFrame:
    return df.filter(F.col("tenant_id").eqNullSafe(F.lit(tenant)))


def scan(
    gold: DataFrame, tenant: int | None = None, indicator: str | None = None, country: str | None = None,
    year_from: int | None = None, year_to: int | None = None, actuals_only: bool = False,
    limit: int | None = 500,
) -> DataFrame:
    """Filtered page of records by period; ``limit`` is the page size (at most 5000)."""
    out = visible_to(gold, tenant)
    if indicator:
        out = out.filter(F.col("indicator_code") == indicator.upper())
    if country:
        out = out.filter(F.col("country_code") == country.upper())
    out = out.filter(periods.in_years(F.col("period"), year_from, year_to))
    if actuals_only:
        out = out.filter(~F.col("is_forecast"))
    out = out.orderBy("period", "record_id")
    return out if limit is None else out.limit(min(limit, 5000))


def timeseries(gold: DataFrame, tenant: int | None, indicator: str, country: str,
               year_from: int | None = None, year_to: int | None = None, limit: int = 50) -> DataFrame:
    return scan(gold, tenant, indicator, country, year_from, year_to, actuals_only=True, limit=limit)


def browse(gold: DataFrame, indicator: str | None = None, country: str | None = None,
           source: str | None = None, limit: int = 500) -> DataFrame:
    """Newest periods first."""
    out = gold
    for name, wanted in (("indicator_code", indicator), ("country_code", country), ("source_code", source)):
        if wanted:
            out = out.filter(F.col(name) == wanted)
    return out.orderBy(F.col("period").desc(), F.col("record_id")).limit(limit)


def compare(gold: DataFrame, tenant: int | None, indicator: str, countries: list[str] | None = None,
            period: str | None = None, g7: bool = False) -> DataFrame:
    """Newest actual per country, or all actuals of one fixed period."""
    wanted = K.G7 if g7 else [c.upper() for c in countries or []]
    if not wanted:
        raise ValueError("give countries or set g7")
    rows = visible_to(gold, tenant).filter(
        (F.col("indicator_code") == indicator.upper()) & F.col("country_code").isin(wanted) & ~F.col("is_forecast")
    )
    if period:
        return rows.filter(F.col("period") == period)
    payload = [c for c in gold.columns if c != "country_code"]
    return keyed.latest(rows, ["country_code"], [F.col("period"), -F.col("record_id")], payload)


def authoritative(gold: DataFrame, year_from: int, year_to: int) -> DataFrame:
    """One record per annual key: best quality, then newest promotion."""
    rows = gold.filter(
        F.col("value").isNotNull() & F.col("period").rlike(r"^\d{4}$")
        & F.col("period").between(str(year_from), str(year_to))
    )
    order = [F.coalesce(F.col("dq_score"), F.lit(-1.0)), F.col("promoted_at"), -F.col("record_id")]
    payload = ["record_id", "value", "standard_unit", "source_code", "dq_score"]
    return keyed.latest(rows, KEY, order, payload)


def annual_pivot(gold: DataFrame, years: list[int]) -> DataFrame:
    """Mean value per country and year, one column per listed year (null when absent)."""
    return (
        gold.withColumn("_year", F.substring("period", 1, 4).cast("int"))
        .groupBy("country_code").pivot("_year", years).agg(F.avg("value"))
    )


def period_matrix(gold: DataFrame, countries: list[str], keys: list[str]) -> DataFrame:
    """Value of each country per period, newest record of a (country, period) first."""
    rows = gold.filter(F.col("country_code").isin(countries))
    newest = keyed.latest(rows, ["indicator_code", "period", "country_code"],
                          [F.col("promoted_at"), F.col("record_id")], ["value"])
    return newest.groupBy(*keys).pivot("country_code", countries).agg(F.max("value"))


def explorer_page(gold: DataFrame, search: str = "", kind: str = "all", sort: str = "period",
                  descending: bool = False, page: int = 300) -> DataFrame:
    """Free-text filter over indicator, country and period; sorted first page."""
    out = gold
    if search:
        needle = search.strip().lower()
        hit = F.lit(False)
        for name in KEY:
            hit = hit | F.lower(F.coalesce(F.col(name), F.lit(""))).contains(needle)
        out = out.filter(hit)
    if kind == "actual":
        out = out.filter(~F.col("is_forecast"))
    elif kind == "forecast":
        out = out.filter(F.col("is_forecast"))
    key = F.coalesce(F.col(sort), F.lit(0)) if sort in ("value", "dq_score") else F.coalesce(F.col(sort).cast("string"), F.lit(""))
    return out.orderBy(key.desc() if descending else key.asc(), "record_id").limit(page)


def overview(gold: DataFrame, bronze: DataFrame, queue: DataFrame, sources: DataFrame, tenant: int) -> DataFrame:
    """One row of headline figures: each table is reduced to one row, then the rows are summed."""
    zero = F.lit(0).cast("bigint")

    def row(df: DataFrame, **given: Column) -> DataFrame:
        names = ["gold_records", "total_ingested", "pending_review", "active_sources", "_dq", "_dq_n"]
        return df.agg(*[given.get(n, F.max(zero)).alias(n) for n in names])

    parts = [
        row(visible_to(gold, tenant), gold_records=F.count(F.lit(1)),
            _dq=F.sum((F.col("dq_score") * 100).cast("bigint")), _dq_n=F.count("dq_score")),
        row(visible_to(bronze, tenant), total_ingested=F.count(F.lit(1))),
        row(owned_by(queue, tenant).filter(F.col("status") == "PENDING"), pending_review=F.count(F.lit(1))),
        row(sources.filter("is_active"), active_sources=F.count(F.lit(1))),
    ]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    total = stacked.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in stacked.columns])
    mean = F.try_divide(F.col("_dq"), F.col("_dq_n")) / 100
    return total.select(
        "gold_records", "total_ingested", "pending_review", "active_sources",
        F.coalesce(rnd(mean, 1), F.lit(0.0)).alias("avg_dq_score"),
    )


def keyword_codes(indicators: DataFrame, topics: DataFrame) -> DataFrame:
    """Catalogue codes whose name or code contains a word of the topic; two defaults when none do.

    ``topics``: topic_id, topic. Matching is per topic row against the fixed
    catalogue held as an array literal, so there is no join of topics with it.
    """
    catalogue = F.array(*[
        F.struct(F.lit(code).alias("code"), F.upper(F.lit(meta[0])).alias("name")) for code, meta in K.INDICATORS.items()
    ])
    words = F.filter(F.split(F.upper(F.col("topic")), r"\s+"), lambda w: w != "")
    found = F.transform(
        F.filter(catalogue, lambda i: F.exists(words, lambda w: i["name"].contains(w) | i["code"].contains(w))),
        lambda i: i["code"],
    )
    default = F.array(F.lit("GDP_GROWTH"), F.lit("CPI_INFLATION"))
    return topics.select("topic_id", F.when(F.size(found) > 0, found).otherwise(default).alias("codes"))


def research_context(gold: DataFrame, news: DataFrame, codes: list[str], tenant: int | None,
                     n_records: int = 20, n_news: int = 5) -> DataFrame:
    """Newest records of the codes and newest news, as ordered text lines."""
    g = visible_to(gold, tenant).filter(F.col("indicator_code").isin(codes)).orderBy(
        F.col("period").desc(), F.col("record_id")
    ).limit(n_records).select(
        F.lit("record").alias("kind"), F.col("record_id").alias("item_id"),
        F.concat(
            F.lit("- "), F.col("indicator_code"), F.lit(" ("), F.col("country_code"), F.lit(", "), F.col("period"),
            F.lit("): "), plain("value"), F.lit(" "), F.col("standard_unit"),
        ).alias("line"),
    )
    n = visible_to(news, tenant).orderBy(F.col("published_at").desc_nulls_last(), F.col("news_id")).limit(n_news).select(
        F.lit("news").alias("kind"), F.col("news_id").alias("item_id"),
        F.concat(F.lit("- "), F.col("title"), F.lit(" ("), F.col("source_name"), F.lit(")")).alias("line"),
    )
    return g.unionByName(n)


def by_sector(gold: DataFrame) -> DataFrame:
    """Each record once for every sector that lists its indicator."""
    pairs = [F.when(F.col("indicator_code").isin(*codes), F.lit(sector)) for sector, codes in K.SECTOR_INDICATORS.items()]
    return gold.withColumn("sector", F.explode(F.array_compact(F.array(*pairs))))


def summary_lines(gold: DataFrame, tenant: int | None, group: str, year_from: int | None = None,
                  limit: int = K.SUMMARY_RECORD_LIMIT) -> DataFrame:
    """Data block per group value: its newest records as sorted lines, with their ids.

    At most ``limit`` records per block by definition, so the collected list is bounded.
    """
    rows = visible_to(gold, tenant).filter(periods.in_years(F.col("period"), year_from, None))
    top = keyed.top_per_key(rows, [group], [F.col("period").desc(), F.col("record_id")], limit)
    line = F.concat(
        F.lit("- "), F.col("indicator_code"), F.lit(": "), plain("value"), F.lit(" "), F.col("standard_unit"),
        F.lit(" ("), F.col("country_code"), F.lit(", "), F.col("period"), F.lit(")"),
        F.when(F.col("is_forecast"), F.lit(" [FORECAST]")).otherwise(F.lit("")),
        F.lit(" [Source: "), F.col("source_code"), F.lit("]"),
    )
    items = F.array_sort(F.collect_list(F.struct("indicator_code", "period", "record_id", line.alias("line"))))
    return top.groupBy(group).agg(items.alias("items")).select(
        group,
        F.array_join(F.transform("items", lambda i: i["line"]), "\n").alias("data_block"),
        F.array_join(F.transform("items", lambda i: i["record_id"].cast("string")), ",").alias("record_ids"),
        F.size("items").cast("bigint").alias("n_records"),
    )


def embedding_backlog(gold: DataFrame, vectors: DataFrame, tenant: int | None) -> DataFrame:
    """Records of the tenant without a vector, with the text to embed.

    ``vectors``: record_id. Records joined by anti-join, so already embedded ones drop out.
    """
    have = vectors.select(F.col("record_id").alias("_rid"))
    todo = owned_by(gold, tenant).join(have, F.col("record_id") == F.col("_rid"), "left_anti")
    c = F.col
    return todo.select("record_id", text.record_text(
        c("indicator_code"), c("country_code"), c("period"), c("value"), c("standard_unit"),
        c("source_code"), c("is_forecast")).alias("text"))
