"""Rate-limit decisions for a table of hits (batch form of the limiter).

Rules: a minute window opens at the first hit 60 s or more after the previous
window opened; inside it at most ``burst`` hits pass; at most ``daily`` hits pass
per calendar day; refused hits count for nothing. The role of an identifier is
constant.

The hits of an identifier and hour are one cell. What an hour does depends on the
hours before only through three numbers: when the open window opened, how many
hits passed in it, how many passed that day. A first pass over the cells
says, for every hit that can be the first to open a window there, what the
hour then makes of these numbers; that is one short row per cell. A fold over the
rows of an identifier gives the numbers that enter each cell, and a second pass
decides the hits. Hits are shuffled twice, and a busy identifier is spread over its hours.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.numeric import lookup
from tidemark.session import materialise

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000  # microseconds
NEVER = -(1 << 62)  # opening time of a window that is long over

_CELL = (
    "identifier bigint, hour bigint, n bigint, burst bigint, daily bigint, "
    "enter array<bigint>, head array<bigint>, passes array<bigint>, opened array<bigint>, last array<bigint>"
)
_STATE = "identifier bigint, hour bigint, opened bigint, passed bigint, used bigint"
_DECIDED = "hit_id bigint, identifier bigint, role string, t bigint, allowed boolean, daily_remaining bigint, minute_remaining bigint, retry_after bigint"


def micros(c):
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def _frames(rows: Iterator[tuple], columns: list[str], size: int = 5000) -> Iterator[pd.DataFrame]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield pd.DataFrame(out, columns=columns)
            out = []
    if out:
        yield pd.DataFrame(out, columns=columns)


def _summary(t: list[int], hour: int, burst: int) -> tuple[list, ...]:
    """For each hit that may open the first window of the hour: its time, the hits before it, the
    hits that pass from it on by the minute rule, and the last window: its opening and its hits.

    A window of the hour before began less than a minute before this one, so these are
    the hits of the first minute and the first one after it.
    """
    after = bisect_left(t, hour + MINUTE)
    can = [i for i in range(min(after + 1, len(t))) if i == 0 or t[i] != t[i - 1]]
    known: dict[int, tuple[int, int, int]] = {}
    for first in reversed(can):
        chain, i = [], first
        while i < len(t) and i not in known:
            chain.append(i)
            i = bisect_left(t, t[i] + MINUTE, i)
        passes, opened, last = known.get(i, (0, None, 0))
        for j in reversed(chain):
            size = i - j
            passes += min(size, burst)
            if opened is None:
                opened, last = t[j], size
            known[j], i = (passes, opened, last), j
    return [t[i] for i in can], can, *(list(c) for c in zip(*(known[i] for i in can)))


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per cell, from hits in order of cell and time; a cell may go on in the next batch."""
    def rows():
        cell, t = None, []
        for pdf in batches:
            for who, hour, at, burst, daily in zip(*(pdf[c].tolist() for c in ("identifier", "hour", "t", "burst", "daily"))):
                if cell is None or hour != cell[1] or who != cell[0]:
                    if cell is not None:
                        yield *cell[:2], len(t), *cell[2:], *_summary(t, cell[1], cell[2])
                    cell, t = (who, hour, burst, daily), []
                t.append(at)
        if cell is not None:
            yield *cell[:2], len(t), *cell[2:], *_summary(t, cell[1], cell[2])

    yield from _frames(rows(), [c.split()[0] for c in _CELL.split(", ")])


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What enters each cell of an identifier, cell by cell in time order."""
    def rows():
        before = None
        for pdf in batches:
            for who, hour, n, burst, daily, enter, head, passes, opens, last in pdf.itertuples(index=False, name=None):
                if who != before:
                    before, day, opened, passed, used = who, None, NEVER, 0, 0
                if hour // DAY != day:
                    day, used = hour // DAY, 0
                yield who, hour, opened, passed, used
                i = int(np.searchsorted(enter, opened + MINUTE))
                goes_on = int(head[i]) if i < len(enter) else n  # hits of the window that is open
                by_minute = min(goes_on, max(0, burst - passed))
                room = daily - used
                if i < len(enter):
                    in_last = min(int(last[i]), burst)
                    allowed = min(room, by_minute + int(passes[i]))
                    opened, passed = int(opens[i]), max(0, allowed - (by_minute + int(passes[i]) - in_last))
                else:
                    allowed = min(room, by_minute)
                    passed += allowed
                used += allowed

    yield from _frames(rows(), [c.split()[0] for c in _STATE.split(", ")])


def _decisions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walks the hits of cell after cell; the first row of a cell holds what enters it."""
    opened, passed, used = NEVER, 0, 0
    for pdf in batches:
        out = []
        columns = (pdf[c].tolist() for c in ("kind", "t", "burst", "daily", "opened", "passed", "used"))
        for kind, t, burst, daily, was_opened, had_passed, was_used in zip(*columns):
            if kind == 0:
                opened, passed, used = was_opened, had_passed, was_used
                continue
            if t - opened >= MINUTE:
                opened, passed = t, 0
            ok, retry = used < daily and passed < burst, None
            if ok:
                used += 1
                passed += 1
            elif used >= daily:
                retry = ((t // DAY + 1) * DAY - t) // 1_000_000
            else:
                retry = max(1, (opened + MINUTE - t) // 1_000_000)
            out.append((ok, max(0, daily - used), max(0, burst - passed), retry))
        hits = pdf.loc[pdf["kind"] == 1, ["hit_id", "identifier", "role", "t"]]
        if out:
            allowed, day, minute, retry = zip(*out)
            yield hits.assign(allowed=allowed, daily_remaining=day, minute_remaining=minute, retry_after=pd.array(retry, "Int64"))


def decide(hits: DataFrame) -> DataFrame:
    """For every hit (hit_id, identifier, role, hit_at): ``allowed``, and what is left after it.

    ``daily_remaining`` and ``minute_remaining`` count hits; ``retry_after`` is the whole seconds
    until a refused hit could pass: to midnight where the day is used up, else to the end of the
    minute window (one at least); null where the hit passes.
    """
    spark = hits.sparkSession
    daily = F.coalesce(lookup(F.col("role"), {r: v[0] for r, v in K.RATE_LIMITS.items()}), F.lit(K.RATE_LIMITS["PUBLIC"][0]))
    burst = F.coalesce(lookup(F.col("role"), {r: v[1] for r, v in K.RATE_LIMITS.items()}), F.lit(K.RATE_LIMITS["PUBLIC"][1]))
    t = micros(F.col("hit_at"))
    rows = hits.select(
        "hit_id", "identifier", "role", "hit_at", t.alias("t"), (t - F.pmod(t, F.lit(HOUR))).alias("hour"),
        burst.cast("bigint").alias("burst"), daily.cast("bigint").alias("daily"),
    )
    cells = (
        rows.select("identifier", "hour", "t", "burst", "daily")
        .repartition("identifier", "hour").sortWithinPartitions("identifier", "hour", "t").mapInPandas(_summaries, _CELL)
    )
    states = materialise(spark, cells.repartition("identifier").sortWithinPartitions("identifier", "hour").mapInPandas(_fold, _STATE), "limit-states")
    # What enters a cell travels as its first row, so that hits are shuffled without a join.
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("string")
    columns = ["identifier", "hour", "kind", "t", "hit_id", "role", "burst", "daily", "opened", "passed", "used"]
    first = states.select("*", F.lit(0).alias("kind"), none.alias("role"), *[zero.alias(c) for c in ("t", "hit_id", "burst", "daily")])
    rest = rows.select("*", F.lit(1).alias("kind"), *[zero.alias(c) for c in ("opened", "passed", "used")])
    decided = (
        first.select(*columns).unionByName(rest.select(*columns)).repartition("identifier", "hour")
        .sortWithinPartitions("identifier", "hour", "kind", "t", "hit_id").mapInPandas(_decisions, _DECIDED)
    )
    at = F.timestamp_add("MICROSECOND", F.col("t"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return decided.select("hit_id", "identifier", "role", at.alias("hit_at"), "allowed", "daily_remaining", "minute_remaining", "retry_after")
