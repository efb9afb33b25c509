"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return (
        edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """node -> root (smallest node of its component) for every node that has an edge.

    ``edges`` holds two bigint columns u and v, in any order, repeated or not. Every round is
    written to the shared folder; rounds grow with the logarithm of the longest path. Nothing
    but a count and a checksum of the edges reaches the driver.
    """
    spark = edges.sparkSession
    edges = (
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    edges = materialise(spark, edges, "edges")
    seen = None
    while True:
        sign = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if sign == seen or not sign[0]:
            break
        seen = sign
        stars = _large_star(edges).where("u <> v").distinct()
        edges = materialise(spark, _small_star(stars).where("u <> v").distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
