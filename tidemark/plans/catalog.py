"""Registry of named queries: a Spark plan over the driver tables, and its check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import sqlviews
from tidemark.session import configure


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None, uses: list[str] | None = None):
    """Register ``build(spark, folder)``; ``uses`` lists the views the SQL refers to as v_<name>."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        text = sqlviews.compose(uses or [], sql) if sql is not None else None

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(configure(spark), folder)

        CATALOG[name] = Query(name, run, text)
        return build

    return register
