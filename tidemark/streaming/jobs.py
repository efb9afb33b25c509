"""Streaming jobs: incremental medallion, windows, sessions, dedupe, late data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import pct_change, rnd
from tidemark.operators import keyed
from tidemark.operators import medallion as M
from tidemark.session import delete, fresh_path
from tidemark.sources import generations, views
from tidemark.streaming import runs


def medallion(spark: SparkSession, path: str, as_of: Column, out: str | None = None, files_per_batch: int | None = None) -> str:
    """Bronze files -> Silver, promotion and review tables, only what is new since the last run.

    The checkpoint remembers what was read, which takes the place of searching
    for unprocessed rows. Returns the folder with ``silver``, ``promoted`` and ``review``.
    """
    out = out or fresh_path(spark, "stream-medallion")

    def handle(batch: DataFrame, batch_id: int) -> None:
        silver = M.to_silver(views.bronze_from(batch), as_of).persist()
        try:
            runs.batch_writer(f"{out}/silver")(silver, batch_id)
            runs.batch_writer(f"{out}/promoted")(silver.filter(F.col("dq_status") == "AUTO_PROMOTED"), batch_id)
            runs.batch_writer(f"{out}/review")(M.review_items(silver, as_of), batch_id)
        finally:
            silver.unpersist()

    stream = runs.event_stream(spark, path, files_per_batch)
    runs.drain_batches(stream, f"{out}/checkpoint", handle)
    return out


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and value totals per event type and time window, emitted once a window is closed."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    cents = F.round(F.col("value") * 100).cast("bigint")
    return (
        events.withWatermark("ts", delay).groupBy(window.alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(cents).alias("cents"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "cents")
    )


def user_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Activity sessions per user: a session ends after a pause of ``gap``."""
    return (
        events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
    )


def first_deliveries(events: DataFrame, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """Repeated deliveries of a key inside the delay are dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def current_values(spark: SparkSession, out: str, every: int = generations.EVERY) -> generations.Generations:
    """Store of the current value of each key (user, kind, day), by day."""
    keys = ["user_id", "event_type", "day"]
    return generations.Generations(spark, f"{out}/current", keys, "user_id bigint, event_type string, value double", "day", "date", every)


def publish(store: generations.Generations, rows: DataFrame, out: str, run: int) -> None:
    """One delivery batch -> publications, each with the value it replaces; the store gets the keys it changed.

    ``rows``: event_id, user_id, event_type, day, delivery, ts, value. Only the days that the
    batch touches are read from the store. A repeated run overwrites what it wrote before.
    """
    store.tidy(run)
    if store.settled(run):
        return
    known = store.newest(run, rows.select("day")).withColumnRenamed("value", "known_value")
    order = Window.partitionBy(*store.keys).orderBy("delivery", "ts", "event_id")
    chained = rows.join(known.withColumn("is_known", F.lit(True)), store.keys, "left").withColumns({
        "place": F.row_number().over(order), "before": F.lag("value").over(order),
    })
    first = F.col("place") == 1
    published = chained.select(
        *rows.columns, F.when(first, F.col("known_value")).otherwise(F.col("before")).alias("old_value"),
        (~first | F.coalesce("is_known", F.lit(False))).alias("revision_flag"),
    )
    runs.batch_writer(f"{out}/published")(published, run)
    store.add(keyed.latest(rows, store.keys, [F.col("delivery"), F.col("ts"), F.col("event_id")], ["value"]), run)


def published_revisions(spark: SparkSession, path: str, out: str, files_per_batch: int | None = None) -> None:
    """Deliveries of observations -> a table of publications, each with the value it replaces.

    Reads what is new under ``path`` (event columns and ``delivery``, the number of the
    delivery). The current value of each key is kept in a store of a bounded number of files a
    day; the history isn't read again. How deliveries are split into batches doesn't matter as
    long as they come in order.
    """
    store = current_values(spark, out)

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(
            "event_id", "user_id", "event_type", F.col("ts").cast("date").alias("day"), "delivery",
            F.col("ts").cast("timestamp_ntz").alias("ts"), "value",
        ).persist()
        try:
            publish(store, rows, out, batch_id)
        finally:
            rows.unpersist()

    runs.drain_batches(runs.event_stream(spark, path, files_per_batch, "delivery bigint"), f"{out}/checkpoint", handle)


HASH_PARTS = 16


def last_hashes(spark: SparkSession, out: str, every: int = generations.EVERY) -> generations.Generations:
    """Store of the last content hash of each source."""
    return generations.Generations(spark, f"{out}/last", ["source_code"], "source_code bigint, content_hash string", "part", "int", every)


def judge_changes(store: generations.Generations, log: DataFrame, out: str, run: int) -> None:
    """One batch of the crawl log -> SKIP where a source's hash is that of its row before, else PROCEED.

    ``log``: log_id, source_code, content_hash, logged_at. The kept hash of a source stands as one
    row before its first row of the batch, so a source with very many rows is still split by hour.
    A null hash is equal to none. A repeated run overwrites what it wrote before.
    """
    store.tidy(run)
    if store.settled(run):
        return
    own = log.withColumn("part", F.pmod(F.xxhash64("source_code"), F.lit(HASH_PARTS)).cast("int"))
    starts = own.groupBy(F.col("source_code").alias("_s")).agg(F.min("logged_at").alias("logged_at"))
    kept = store.newest(run, own.select("part")).join(starts, F.col("source_code").eqNullSafe(F.col("_s"))).drop("_s")
    rows = own.withColumn("_kept", F.lit(False)).unionByName(kept.withColumn("_kept", F.lit(True)), allowMissingColumns=True)
    work = f"{out}/work"
    carried = keyed.carry(rows, ["source_code"], "logged_at", "log_id", F.struct("content_hash"), "_before", folder=work)
    same = F.col("_before.content_hash") == F.col("content_hash")
    decided = carried.where(~F.col("_kept")).select(
        "log_id", "source_code", "content_hash", F.when(same, "SKIP").otherwise("PROCEED").alias("decision")
    )
    runs.batch_writer(f"{out}/changes")(decided, run)
    delete(store.spark, work)
    store.add(keyed.latest(own, ["source_code"], [F.col("logged_at"), F.col("log_id")], ["content_hash", "part"]), run)


def content_changes(spark: SparkSession, path: str, out: str, files_per_batch: int | None = None) -> None:
    """Crawl log as a stream -> table of decisions, with the last hash of each source kept over batches.

    The distributed form of ``stateful.detect_changes``: no task walks all rows of a source.
    """
    store = last_hashes(spark, out)

    def handle(batch: DataFrame, batch_id: int) -> None:
        log = views.crawl_log_from(batch).select("log_id", "source_code", "content_hash", "logged_at").persist()
        try:
            judge_changes(store, log, out, batch_id)
        finally:
            log.unpersist()

    runs.drain_batches(runs.event_stream(spark, path, files_per_batch), f"{out}/checkpoint", handle)


def with_lateness(published: DataFrame, delay_days: int = 1) -> DataFrame:
    """Marks what was late when delivered: older than the newest of all earlier deliveries, minus the delay.

    There are few deliveries, so their maxima are carried along one window and joined back.
    """
    newest = published.groupBy("delivery").agg(F.max("ts").alias("newest"))
    before = Window.orderBy("delivery").rowsBetween(Window.unboundedPreceding, -1)
    limits = newest.select(F.col("delivery").alias("_d"), F.timestamp_add("DAY", F.lit(-delay_days), F.max("newest").over(before)).alias("_limit"))
    return published.join(limits, F.col("delivery") == F.col("_d")).select(
        *published.columns, F.coalesce(F.col("ts") < F.col("_limit"), F.lit(False)).alias("late"),
        rnd(pct_change("value", "old_value"), 4).alias("revision_pct"),
    )
