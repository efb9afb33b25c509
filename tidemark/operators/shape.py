"""Plan-shape helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fix derived columns at this point of the plan.

    A filter on a derived column is otherwise pushed below the projection and
    rewritten in terms of the raw columns; with layered formulas (status of a
    score of a parsed value) that repeats the inner expressions many times over.
    Passing the columns through ``inline`` of a one-row array keeps each row's
    formulas evaluated once, still inside generated code.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns)))).select(*df.columns)
