"""Per-key state machines on streams: rate limiter, block ladder, content change.

Each keeps a few numbers per key and consumes its micro-batch rows in time
order. Micro-batch size (files or bytes per trigger) bounds what one call sorts.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark import constants as K
from tidemark.operators.limits import DAY, MINUTE, micros


def _in_order(rows: Iterator[pd.DataFrame], *columns: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(columns))


BUCKETS = 4096  # groups of identifiers that a call of the limiter takes together; part of the state's key
PACK = 100  # hits in a packed row at most, so that a batch of such rows stays small
NO_ID, NO_IDENTIFIER = 1, 2  # bits of ``blank``


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hits of a batch as arrays, by identifier, role and ``blank``: fewer rows for the state machine."""
    keys = ["identifier", "role", "blank"]
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if rows["t"].null_count:
            raise ValueError("a hit has no time")
        packed = rows.group_by(keys, use_threads=False).aggregate([("hit_id", "list"), ("t", "list")]).combine_chunks()
        offsets = packed["t_list"].chunk(0).offsets.to_numpy()
        pieces = -(-np.diff(offsets) // PACK)
        group = np.repeat(np.arange(len(pieces)), pieces)
        nth = np.arange(len(group)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        cuts = pa.array(np.append(offsets[group] + nth * PACK, offsets[-1]), pa.int32())
        columns = {c: packed[c].chunk(0).take(pa.array(group)) for c in keys}
        columns |= {c: pa.ListArray.from_arrays(cuts, packed[f"{c}_list"].chunk(0).values) for c in ("hit_id", "t")}
        yield pa.RecordBatch.from_pydict(columns)


class _Days:
    """Days of one identifier: hits let through, opening of the last window, hits let through in it, when touched.

    ``SPAN`` days share a row of the state, because a call to the state store costs far more than a hit.
    """

    SPAN = 32

    def __init__(self, rows, identifier: int | None, known: bool, ttl: int | None, now: int):
        self.rows, self.identifier, self.known, self.ttl, self.now = rows, identifier, known, ttl, now
        self.spans: dict[int, dict[int, list]] = {}
        self.touched: dict[int, list] = {}

    def _read(self, span: int) -> dict[int, list]:
        if not self.known or not self.rows.containsKey((self.identifier, span)):
            return {}
        days = zip(*self.rows.getValue((self.identifier, span)))
        return {day: state for day, *state in days if self.ttl is None or self.now < state[3] + self.ttl}

    def of(self, day: int) -> list:
        if day not in self.touched:
            span = day // self.SPAN
            if span not in self.spans:
                self.spans[span] = self._read(span)
            self.touched[day] = self.spans[span].setdefault(day, [0, None, 0, 0])
        return self.touched[day]

    def keep(self) -> None:
        for state in self.touched.values():
            state[3] = self.now
        for span, days in self.spans.items():
            kept = [(day, *state) for day, state in days.items() if state[0] or state[1] is not None]
            if kept:
                self.rows.updateValue((self.identifier, span), tuple(list(c) for c in zip(*kept)))


class RateLimiter(StatefulProcessor):
    """Daily counts and anchored minute windows per identifier, a few numbers for each day.

    A hit that arrives late, however late, is judged by the counts of its own day. Only the state rows of the
    days that a micro-batch touches, and of the ones before them, are read. With ``ttl_days`` a day that wasn't
    touched for that long is forgotten; this needs processing time, under which a one-shot
    (availableNow) run doesn't end. A call takes the identifiers of a bucket one after another.
    """

    CHUNK = 10_000  # rows put out at once

    def __init__(self, ttl_days: int | None):
        self.ttl = ttl_days * DAY // 1000 if ttl_days else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        value = ", ".join(f"{c} array<bigint>" for c in ("day", "used", "opened", "passed", "touched"))
        self.rows = handle.getMapState("days", "identifier bigint, span bigint", value, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, known = timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0, self.rows.exists()
        kinds, hit_ids, times, kind = _in_time_order(rows)
        identifiers, roles, blank = (np.array(c, dtype=t) for c, t in zip(zip(*kinds), ("int64", object, "int8")))
        rules = [(i, None if b & NO_IDENTIFIER else i, *K.RATE_LIMITS.get(r, K.RATE_LIMITS["PUBLIC"])) for i, r, b in kinds]
        who, days, today, own = (), None, None, None
        for start in range(0, len(times), self.CHUNK):
            chunk, out = slice(start, start + self.CHUNK), []
            for t, k in zip(times[chunk].tolist(), kind[chunk].tolist()):
                _, identifier, daily, burst = rules[k]
                if identifier != who:
                    if days is not None:
                        days.keep()
                    who, days, today = identifier, _Days(self.rows, identifier, known, self.ttl, now), None
                if t // DAY != today:
                    today = t // DAY
                    own = days.of(today)
                source = own
                if own[1] is None:  # a window that goes on over midnight may be open
                    before = days.of(today - 1)
                    source = before if before[1] is not None else own
                if source[1] is None or t - source[1] >= MINUTE:
                    own[1], own[2], source = t, 0, own
                ok, retry = own[0] < daily and source[2] < burst, 0
                if ok:
                    own[0] += 1
                    source[2] += 1
                elif own[0] >= daily:
                    retry = ((today + 1) * DAY - t) // 1_000_000
                else:
                    retry = max(1, (source[1] + MINUTE - t) // 1_000_000)
                out.append((ok, max(0, daily - own[0]), max(0, burst - source[2]), retry))
            of, none = kind[chunk], blank[kind[chunk]]
            allowed, daily_left, minute_left, retry = np.array(out, dtype=np.int64).T
            yield pd.DataFrame({
                "hit_id": _nullable(hit_ids[chunk], none & NO_ID), "identifier": _nullable(identifiers[of], none & NO_IDENTIFIER),
                "role": roles[of], "t": times[chunk], "allowed": allowed.astype(bool),
                "daily_remaining": daily_left, "minute_remaining": minute_left, "retry_after": _nullable(retry, allowed),
            })
        days.keep()

    def close(self) -> None:
        pass


def _nullable(values: np.ndarray, none: np.ndarray) -> pd.api.extensions.ExtensionArray:
    return pd.arrays.IntegerArray(np.ascontiguousarray(values), none.astype(bool))


def _in_time_order(frames: Iterator[pd.DataFrame]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Kinds (identifier, role, ``blank``) of packed hits; ids, times and kinds' numbers in order of identifier, time and id (none last)."""
    kinds, ids, times, kind = {}, [], [], []
    for pdf in frames:
        found = zip(pdf["identifier"].tolist(), [r if isinstance(r, str) else None for r in pdf["role"]], pdf["blank"].tolist())
        numbers = [kinds.setdefault(k, len(kinds)) for k in found]
        kind.append(np.repeat(numbers, [len(t) for t in pdf["t"]]))
        ids.append(np.concatenate(list(pdf["hit_id"])))
        times.append(np.concatenate(list(pdf["t"])))
    ids, times, kind = (np.concatenate(c) for c in (ids, times, kind))
    identifier, blank = (np.array([k[n] for k in kinds])[kind] for n in (0, 2))
    order = np.lexsort((ids, blank & NO_ID, times, identifier, blank & NO_IDENTIFIER))
    return list(kinds), ids[order], times[order], kind[order]


def _ms(at: pd.Timestamp | dt.datetime) -> int:
    """Milliseconds since the epoch of a time without zone (UTC)."""
    return int(pd.Timestamp(at).value // 1_000_000)


class BlockLadder(StatefulProcessor):
    """Blocks so far per source -> cooldown or permanent block, and an unblock row when a cooldown ends.

    A cooldown ends at its time unless another block comes before it. If a later block of the
    source has arrived, the end is known at once; otherwise an event-time timer reports it when
    the watermark has passed it, without any new row of the source. The pending cooldown is
    forgotten with that. The number of blocks is kept for good, as the ladder asks, unless
    ``forget_days`` ends it so long after the last block.
    """

    def __init__(self, forget_days: int | None = None):
        self.forget_days = forget_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n bigint, last_ms bigint")
        self.pending = handle.getValueState("pending", "block_id bigint, n bigint, until timestamp")

    def _row(self, kind: str, url, block_id: int, n: int, until) -> dict:
        return {"kind": kind, "block_id": block_id, "source_url": url, "block_count": n, "is_permanent": n >= K.BLOCKS_UNTIL_PERMANENT, "cooldown_until": until}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        blocks = _in_order(rows, "blocked_at", "block_id")
        n, last_ms = self.count.get() if self.count.exists() else (0, None)
        patience = (self.forget_days or 0) * 86_400_000
        open_ = self.pending.get() if self.pending.exists() else None
        if open_ is not None:
            self.handle.deleteTimer(_ms(open_[2]))
        if patience and n:
            self.handle.deleteTimer(last_ms + patience)
        out = []
        for block_id, at in zip(blocks["block_id"], blocks["blocked_at"]):
            if open_ is not None and open_[2] <= at:
                out.append(self._row("unblock", key[0], open_[0], open_[1], open_[2]))
            n = 1 if patience and n and _ms(at) >= last_ms + patience else n + 1
            last_ms, until = _ms(at), None
            if n < K.BLOCKS_UNTIL_PERMANENT:
                until = at + pd.Timedelta(hours=K.BLOCK_COOLDOWN_HOURS[min(n, len(K.BLOCK_COOLDOWN_HOURS)) - 1])
            open_ = None if until is None else (int(block_id), n, until)
            out.append(self._row("block", key[0], block_id, n, until))
        self.count.update((n, last_ms))
        if open_ is None:
            self.pending.clear()
        else:
            self.pending.update((open_[0], open_[1], open_[2].to_pydatetime()))
            self.handle.registerTimer(_ms(open_[2]))
        if patience:
            self.handle.registerTimer(last_ms + patience)
        yield _block_frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.pending.exists():
            block_id, n, until = self.pending.get()
            if _ms(until) <= at:
                self.pending.clear()
                yield _block_frame([self._row("unblock", key[0], block_id, n, until)])
        if self.forget_days and self.count.exists() and self.count.get()[1] + self.forget_days * 86_400_000 <= at:
            self.count.clear()

    def close(self) -> None:
        pass


def _block_frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["kind", "block_id", "source_url", "block_count", "is_permanent", "cooldown_until"])
    return out.assign(cooldown_until=pd.to_datetime(out["cooldown_until"]))


class Freshness(StatefulProcessor):
    """State of each watched indicator at the end of every period, also of those that don't arrive.

    Watched indicators come as initial state, which starts a chain of event-time timers, one at
    the end of each period. Arrivals are noted by period; a timer takes those up to its own end,
    so what arrived later in the same micro-batch doesn't count yet.
    """

    def __init__(self, start: dt.datetime, minutes: int):
        self.start_ms, self.step = _ms(start), minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.watched = handle.getValueState("watched", "tier string, window_minutes int, next_ms bigint")
        self.last = handle.getValueState("last", "at timestamp")
        self.arrived = handle.getMapState("arrived", "period bigint", "at timestamp")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        first = self.start_ms + self.step
        self.watched.update((row["tier"], int(row["window_minutes"]), first))
        self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            ms = frame["crawled_at"].astype("datetime64[ns]").astype("int64") // 1_000_000
            # An arrival at the very end of a period still belongs to it.
            period = (ms - self.start_ms + self.step - 1).clip(lower=0) // self.step
            for number, at in frame.groupby(period)["crawled_at"].max().items():
                known = self.arrived.getValue((int(number),)) if self.arrived.containsKey((int(number),)) else None
                if known is None or known[0] < at:
                    self.arrived.updateValue((int(number),), (at.to_pydatetime(),))
        yield pd.DataFrame(columns=_FRESH_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tier, window, tick = self.watched.get()
        last = self.last.get()[0] if self.last.exists() else None
        now, out = timerValues.getCurrentWatermarkInMs(), []
        noted = sorted((k[0], v[0]) for k, v in self.arrived.iterator())
        while tick < now:
            end = (tick - self.start_ms) // self.step
            for number, at in [x for x in noted if x[0] <= end]:
                last = at if last is None or at > last else last
                self.arrived.removeKey((number,))
            noted = [x for x in noted if x[0] > end]
            at = pd.Timestamp(tick, unit="ms")
            age = -1.0 if last is None else (at - pd.Timestamp(last)).total_seconds() / 60
            out.append((key[0], tier, window, at, last, age, last is not None and age <= window))
            tick += self.step
        if last is not None:
            self.last.update((last,))
        self.watched.update((tier, window, tick))
        self.handle.registerTimer(tick)
        frame = pd.DataFrame(out, columns=_FRESH_COLUMNS)
        yield frame.assign(last_crawled_at=pd.to_datetime(frame["last_crawled_at"]))

    def close(self) -> None:
        pass


_FRESH_COLUMNS = ["indicator_code", "tier", "window_minutes", "checked_at", "last_crawled_at", "age_minutes", "compliant"]


class ContentChange(StatefulProcessor):
    """Last content hash per source; the same hash again means skip."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "content_hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        log = _in_order(rows, "logged_at", "log_id")
        before = self.last.get()[0] if self.last.exists() else None
        previous = log["content_hash"].shift(1)
        previous.iloc[0] = before
        self.last.update((log["content_hash"].iloc[-1],))
        yield log[["log_id", "source_code", "content_hash"]].assign(
            decision=["SKIP" if a == b else "PROCEED" for a, b in zip(previous, log["content_hash"])]
        )

    def close(self) -> None:
        pass


def _stateful(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str = "None") -> DataFrame:
    """Needs the RocksDB state store, which ``session.configure`` sets."""
    return df.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time
    )


def limit_hits(hits: DataFrame, ttl_days: int | None = None) -> DataFrame:
    """Decisions as ``limits.decide`` gives them, with what is left after each hit.

    Hits are shuffled as arrays, by buckets of identifiers. A hit without a time is an error. A null identifier
    counts as one of its own.
    """
    blank = F.when(F.col("hit_id").isNull(), NO_ID).otherwise(0) + F.when(F.col("identifier").isNull(), NO_IDENTIFIER).otherwise(0)
    rows = hits.select(
        F.coalesce(F.col("identifier").cast("bigint"), F.lit(0)).alias("identifier"), F.col("role").cast("string").alias("role"), blank.alias("blank"),
        F.coalesce(F.col("hit_id").cast("bigint"), F.lit(0)).alias("hit_id"), micros(F.col("hit_at").cast("timestamp_ntz")).alias("t"),
    )
    packed = rows.mapInArrow(_packed, "identifier bigint, role string, blank int, hit_id array<bigint>, t array<bigint>")
    decided = _stateful(
        packed.withColumn("bucket", F.pmod(F.xxhash64("identifier"), F.lit(BUCKETS))), "bucket", RateLimiter(ttl_days),
        "hit_id bigint, identifier bigint, role string, t bigint, allowed boolean, daily_remaining bigint, minute_remaining bigint, retry_after bigint",
        "ProcessingTime" if ttl_days else "None",
    )
    at = F.timestamp_add("MICROSECOND", F.col("t"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return decided.withColumn("t", at.cast("timestamp")).withColumnRenamed("t", "hit_at")


def escalate_blocks(blocks: DataFrame, delay: str = "1 hour", forget_days: int | None = None) -> DataFrame:
    """Rows ``block`` as they come and ``unblock`` as cooldowns end; blocks later than ``delay`` are dropped."""
    zoned = blocks.withColumn("blocked_at", F.col("blocked_at").cast("timestamp")).withWatermark("blocked_at", delay)
    return _stateful(
        zoned, "source_url", BlockLadder(forget_days),
        "kind string, block_id bigint, source_url bigint, block_count bigint, is_permanent boolean, cooldown_until timestamp", "EventTime",
    )


def freshness(arrivals: DataFrame, watched: DataFrame, start: dt.datetime, minutes: int, delay: str = "1 hour") -> DataFrame:
    """State of every watched indicator every ``minutes`` from ``start`` on, once the watermark has passed that time.

    ``arrivals``: indicator_code, crawled_at; ``watched``: indicator_code, tier, window_minutes.
    An indicator that never arrived has the age -1; indicators that aren't watched are dropped.
    """
    codes = watched.select(F.col("indicator_code").alias("_w"))
    zoned = arrivals.withColumn("crawled_at", F.col("crawled_at").cast("timestamp")).withWatermark("crawled_at", delay)
    known = zoned.join(codes, F.col("indicator_code") == F.col("_w"), "left_semi").select("indicator_code", "crawled_at")
    return known.groupBy("indicator_code").transformWithStateInPandas(
        statefulProcessor=Freshness(start, minutes), outputMode="Append", timeMode="EventTime", initialState=watched.groupBy("indicator_code"),
        outputStructType="indicator_code string, tier string, window_minutes int, checked_at timestamp, last_crawled_at timestamp, age_minutes double, compliant boolean",
    )


def detect_changes(log: DataFrame) -> DataFrame:
    zoned = log.withColumn("logged_at", F.col("logged_at").cast("timestamp"))
    return _stateful(zoned, "source_code", ContentChange(),
                     "log_id bigint, source_code bigint, content_hash string, decision string")
