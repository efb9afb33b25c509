"""Vector and keyword search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import rnd
from tidemark.operators import vector_index
from tidemark.operators.published import visible_to


def l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, s: acc + s))


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """Mean vector per key. Components are summed as wide scaled integers: exact and order-free."""
    parts = vectors.select(key, F.posexplode("embedding").alias("i", "x"))
    scaled = F.floor(F.col("x").cast("double") * 1e9)
    total = F.sum(scaled.cast("decimal(28,0)")).cast("double")
    means = parts.groupBy(key, "i").agg((total / F.count(F.lit(1)) / 1e9).alias("m"))
    return means.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding")
    )


def search_one(vectors: DataFrame, query: list[float], k: int = 6) -> DataFrame:
    """Top k for one query vector: a distributed scan with a bounded top-k, no shuffle."""
    target = F.array(*[F.lit(float(x)) for x in query])
    return (
        vectors.filter(F.col("embedding").isNotNull())
        .withColumn("distance", rnd(l2(F.col("embedding"), target), 6))
        .orderBy("distance", "vec_id").limit(k)
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 6, probes: int | None = None) -> DataFrame:
    """Top k of every query by L2 distance, through an index of the vectors; see ``vector_index``.

    ``vectors``: vec_id, embedding; ``queries``: query_id (bigint), embedding. Exact unless
    ``probes`` limits the cells that are looked into.
    """
    index = vector_index.build(vectors)
    if index is None:
        return queries.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, distance double, rank int")
    return vector_index.search(queries.sparkSession, index, queries, k, probes)


def newest_records(gold: DataFrame, tenant: int | None, k: int = 6) -> DataFrame:
    """What a search falls back to when no vector is available."""
    return visible_to(gold, tenant).orderBy(F.col("promoted_at").desc(), F.col("record_id").desc()).limit(k)


def keyword_news(news: DataFrame, words: str, tenant: int | None, country: str | None = None, limit: int = 5) -> DataFrame:
    """Articles whose title or content contains the words, newest first."""
    pool = visible_to(news, tenant)
    if country:
        pool = pool.filter(F.col("country_code") == country.upper())
    needle = words.lower()
    hit = F.lower(F.col("title")).contains(needle) | F.lower(F.col("content")).contains(needle)
    return pool.filter(hit).orderBy(F.col("published_at").desc_nulls_last(), F.col("news_id")).limit(limit).select(
        "news_id", "title", "source_name", "published_at", "country_code",
        F.substring(F.coalesce("content", F.lit("")), 1, 300).alias("snippet"),
    )
