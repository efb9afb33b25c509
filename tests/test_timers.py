"""Streams in which only time passes, and streams cut into different micro-batches."""

import datetime as dt

import pytest

from tidemark.session import fresh_path
from tidemark.streaming import runs, stateful

T0 = dt.datetime(2024, 1, 1)


def files(spark, batches, schema):
    """One file per batch, in order; read back as a stream that takes one file, or all, at a time."""
    path = fresh_path(spark, "landing")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    def stream(per_batch):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)

    return stream


def minutes(n):
    return T0 + dt.timedelta(minutes=n)


BLOCKS = "block_id bigint, source_url bigint, blocked_at timestamp_ntz"


def ladder(spark, stream, **options):
    rows = runs.drain_to_files(spark, stateful.escalate_blocks(stream, **options), "ladder").collect()
    return sorted((r.source_url, r.kind, r.block_id, r.block_count, r.is_permanent) for r in rows)


def test_cooldown_ends_without_a_row_of_its_source(spark):
    stream = files(spark, [[(1, 7, minutes(0))], [(2, 8, minutes(200))]], BLOCKS)
    got = ladder(spark, stream(1))
    assert (7, "unblock", 1, 1, False) in got and (8, "unblock", 2, 1, False) not in got
    rows = runs.drain_to_files(spark, stateful.escalate_blocks(stream(1)), "ladder").where("kind = 'unblock'").collect()
    assert [r.cooldown_until for r in rows] == [minutes(60)]


def test_ladder_doesnt_depend_on_batches(spark):
    batches = [
        [(1, 7, minutes(0)), (2, 9, minutes(1))], [(3, 7, minutes(30))], [(4, 9, minutes(61))],
        [(5, 7, minutes(400)), (6, 11, minutes(401))], [(7, 9, minutes(2000)), (8, 12, minutes(2001))],
    ]
    stream = files(spark, batches, BLOCKS)
    whole = ladder(spark, stream(100))
    assert whole == ladder(spark, stream(1)) == ladder(spark, stream(2))
    unblocked = [(u, b) for u, kind, b, _, _ in whole if kind == "unblock"]
    assert unblocked == [(7, 3), (9, 2), (9, 4), (11, 6)]  # source 7 was blocked again inside its first cooldown
    assert (7, "block", 5, 3, True) in whole


def test_ladder_is_forgotten_only_if_asked(spark):
    stream = files(spark, [[(1, 7, minutes(0))], [(2, 8, minutes(60 * 24 * 5))], [(3, 7, minutes(60 * 24 * 5 + 1))]], BLOCKS)
    assert (7, "block", 3, 2, False) in ladder(spark, stream(1))
    assert (7, "block", 3, 1, False) in ladder(spark, stream(1), forget_days=2)


ARRIVALS = "indicator_code string, crawled_at timestamp_ntz"


@pytest.mark.parametrize("per_batch", [1, 2, 100])
def test_indicator_that_stops_arriving_is_reported(spark, per_batch):
    batches = [[("A", minutes(10)), ("B", minutes(60)), ("X", minutes(5))], [("A", minutes(130)), ("A", minutes(120))], [("A", minutes(301))], [("A", minutes(370))]]
    watched = spark.createDataFrame([("A", "T", 60), ("B", "T", 60), ("C", "T", 60)], "indicator_code string, tier string, window_minutes int")
    stream = files(spark, batches, ARRIVALS)(per_batch)
    rows = runs.drain_to_files(spark, stateful.freshness(stream, watched, T0, 60, "1 minute"), "fresh").collect()
    got = {(r.indicator_code, int((r.checked_at - T0).total_seconds() // 60)): (r.age_minutes, r.compliant) for r in rows}
    arrived = {"A": [10, 120, 130, 301, 370], "B": [60], "C": []}
    want = {}
    for code, times in arrived.items():
        for tick in range(60, 361, 60):
            before = [t for t in times if t <= tick]
            want[code, tick] = (float(tick - max(before)), tick - max(before) <= 60) if before else (-1.0, False)
    assert got == want
    assert len(rows) == len(got)  # each check once
