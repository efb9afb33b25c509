"""Per-key building blocks that stay balanced when one key holds much of the data.

``latest`` / ``best`` aggregate with partial (map-side) combine, so a hot key is
reduced before the shuffle. ``top_per_key`` filters ``row_number() <= n`` right
above the window, which Spark turns into a per-partition group limit before the
exchange. ``carry`` splits each key by time bucket and stitches the
buckets through a small per-bucket summary; several values share one placement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise


def latest(df: DataFrame, keys: list[str], order: list[Column], payload: list[str]) -> DataFrame:
    """Row with the greatest ``order`` per key."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*payload), rank).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload])


def earliest(df: DataFrame, keys: list[str], order: list[Column], payload: list[str]) -> DataFrame:
    """Row with the smallest ``order`` per key."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*payload), rank).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload])


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def carry(
    df: DataFrame, keys: list[str], at: str, tie: str, value: Column, out: str, bucket: str = "HOUR",
    forward: bool = True, include_self: bool = False, folder: str | None = None,
) -> DataFrame:
    """Nearest non-null ``value`` before (or after) each row of its key, in (at, tie) order."""
    return carry_several(df, keys, at, tie, {out: (value, [])}, bucket, forward, include_self, folder)


def carry_several(
    df: DataFrame, keys: list[str], at: str, tie: str, values: dict[str, tuple[Column, list[str]]], bucket: str = "HOUR",
    forward: bool = True, include_self: bool = False, folder: str | None = None,
) -> DataFrame:
    """``carry`` of several values over one placement: output column -> (value, further key columns of this value).

    The rows are written once (to ``folder``, if given, which the caller deletes), so that
    whatever they come from is worked out once. A key is then
    handled one time bucket at a time. What enters a bucket comes from the nearest non-empty
    bucket on that side, found on a summary (one row per key, further keys and bucket,
    pre-aggregated). The summary rows go before the bucket's own rows in the same shuffle by (key,
    bucket), which serves all values. Key and bucket are one struct, which is never null itself.
    """
    place = F.struct(*[F.col(k) for k in keys], F.date_trunc(bucket, F.col(at)).alias("_bucket"))
    held = {f"_v{i}": value for i, (value, _) in enumerate(values.values())}
    b = materialise(df.sparkSession, df.select("*", place.alias("_place"), *[v.alias(c) for c, v in held.items()]), "carry", folder)

    def ordered(*columns: str) -> list[Column]:
        return [F.col(c).asc() if forward else F.col(c).desc() for c in columns]

    whole = [F.col(f"_place.{k}") for k in keys]
    rows = b.withColumn("_own", F.lit(True))
    for c, (_, further) in zip(held, values.values()):
        order = F.when(F.col(c).isNotNull(), F.struct(F.col(at), F.col(tie)))
        edge = F.max_by(c, order) if forward else F.min_by(c, order)
        earlier = Window.partitionBy(F.struct(*whole, *further)).orderBy(*ordered("_place._bucket")).rowsBetween(Window.unboundedPreceding, -1)
        entering = F.last("_end", ignorenulls=True).over(earlier)
        ends = b.groupBy("_place", *further).agg(edge.alias("_end")).select("_place", *further, entering.alias(c))
        rows = rows.unionByName(ends.where(F.col(c).isNotNull()).withColumn("_own", F.lit(False)), allowMissingColumns=True)
    rows = rows.repartition("_place")
    for out, c in zip(values, held):
        inside = Window.partitionBy("_place", *values[out][1]).orderBy("_own", *ordered(at, tie)).rowsBetween(
            Window.unboundedPreceding, 0 if include_self else -1
        )
        rows = rows.withColumn(out, F.last(c, ignorenulls=True).over(inside))
    return rows.where("_own").select(*df.columns, *values)


def carry_forward(df: DataFrame, keys: list[str], at: str, tie: str, value: Column, out: str, bucket: str = "HOUR") -> DataFrame:
    """Latest non-null ``value`` strictly before each row of its key."""
    return carry(df, keys, at, tie, value, out, bucket)


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Position (from 1) of every row in the whole order, without a window over all rows.

    Rows are dealt into ranges of the order and written with the number of their range; the
    sizes of the ranges, one number each, are summed up on the driver, and rows are counted
    inside their range. Rows that are equal in ``order`` get positions in no given order.
    """
    ranged = materialise(df.sparkSession, df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for k in sorted(sizes):
        offsets.append((k, before))
        before += sizes[k]
    starts = df.sparkSession.createDataFrame(offsets, "_range int, _start bigint")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(starts, "_range").withColumn(out, F.col("_start") + inside).drop("_range", "_start")


def first_seen(df: DataFrame, keys: list[Column], position: list[Column], payload: list[str]) -> DataFrame:
    """Keep the first row (by position) of each key; null-safe keys, order-preserving dedupe."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    rank = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(position)])
    picked = df.groupBy(*named).agg(F.min_by(F.struct(*payload), rank).alias("_row"))
    return picked.select(*[F.col(f"_row.{c}").alias(c) for c in payload])


def sql_ranks(column: str, ordered: list[str]) -> Column:
    """Position of a value in a fixed ordered list (0-based)."""
    return F.array_position(F.array(*[F.lit(v) for v in ordered]), F.col(column)) - 1
