"""Streaming queries: each runs over the event files to the end and returns its result table."""

from __future__ import annotations

import datetime as dt
from functools import partial

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.numeric import rnd
from tidemark.operators import medallion as M
from tidemark.plans import sqlviews as V
from tidemark.plans.catalog import query
from tidemark.plans.limits import rate_limit_decisions  # noqa: F401 - shares its check
from tidemark.plans.catalog import CATALOG
from tidemark.session import fresh_path
from tidemark.sources import views
from tidemark.sources.tables import table
from tidemark.streaming import jobs, runs, stateful, unique

AS_OF = partial(views.clock, views.AS_OF_EVENTS)


def _events(folder: str) -> str:
    return f"{folder}/events*.parquet"


def _plain_times(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@query("stream_medallion", uses=["silver"], sql=f"""
  SELECT source_code, dq_status, count(*) AS n, {V.rnd('CAST(sum(CAST(dq_score * 100 AS BIGINT)) AS BIGINT) / count(*) / 100', 4)} AS avg_dq FROM v_silver GROUP BY ALL""")
def stream_medallion(spark, folder):
    out = jobs.medallion(spark, _events(folder), AS_OF())
    return M.status_counts(spark.read.parquet(f"{out}/silver")).withColumn("avg_dq", rnd("avg_dq", 4))


@query("stream_windows", sql="""
  WITH d AS (SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2)
  SELECT *, window_start + INTERVAL 1 DAY AS window_end FROM d WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_windows(spark, folder):
    """Closed daily windows."""
    closed = jobs.windowed_counts(runs.event_stream(spark, _events(folder)), "1 day")
    return _plain_times(runs.drain_to_files(spark, closed, "stream-windows"), "window_start", "window_end")


@query("stream_sliding_windows", sql="""
  WITH s AS (SELECT date_trunc('day', ts) - to_days(k) AS window_start, event_type, value FROM events, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS k))
  SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM s GROUP BY ALL HAVING window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sliding_windows(spark, folder):
    """Closed seven-day windows, one starting every day."""
    closed = jobs.windowed_counts(runs.event_stream(spark, _events(folder)), "7 days", "1 day")
    return _plain_times(runs.drain_to_files(spark, closed, "stream-sliding"), "window_start", "window_end")


@query("stream_sessions", sql="""
  WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM n GROUP BY user_id, s
  HAVING session_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark, folder):
    """Closed activity sessions per user."""
    closed = jobs.user_sessions(runs.event_stream(spark, _events(folder)))
    return _plain_times(runs.drain_to_files(spark, closed, "stream-sessions"), "session_start", "session_end")


@query("stream_dedupe", sql="SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY ALL")
def stream_dedupe(spark, folder):
    """Every event is delivered twice and counted once."""
    twice = runs.event_stream(spark, _events(folder)).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    once = runs.drain_to_files(spark, jobs.first_deliveries(twice), "stream-dedupe")
    return once.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("stream_unique_urls", sql="""
  WITH d AS (SELECT page_id, url, CAST(CASE WHEN page_id % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS delivery FROM pages)
  SELECT arg_min(page_id, (delivery, page_id)) AS page_id, url, min(delivery) AS delivery FROM d GROUP BY url""")
def stream_unique_urls(spark, folder):
    """A third of the articles, then all of them, then all of them again: each url is accepted once and for all."""
    landing, out = fresh_path(spark, "url-landing"), fresh_path(spark, "url-out")
    pages = table(spark, folder, "pages").select("page_id", "url")
    schema = "page_id bigint, url string, delivery bigint"
    accepted = None
    for n, rows in enumerate((pages.where("page_id % 3 = 0"), pages, pages), 1):
        rows.withColumn("delivery", F.lit(n).cast("bigint")).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", runs.FILES_PER_BATCH).parquet(landing)
        accepted = unique.unique_deliveries(stream, out, "url", ["delivery", "page_id"])
    return accepted


@query("stream_late_revisions", sql=f"""
  WITH d AS (SELECT *, CAST(CASE WHEN event_id % 10 = 0 THEN 3 WHEN event_id % 10 = 1 THEN 2 ELSE 1 END AS BIGINT) AS delivery, CAST(ts AS DATE) AS day FROM events),
  m AS (SELECT delivery AS md, max(max(ts)) OVER (ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS lim FROM d GROUP BY delivery),
  w AS (SELECT *, lag(value) OVER k AS old_value, row_number() OVER k > 1 AS revision_flag FROM d WINDOW k AS (PARTITION BY user_id, event_type, day ORDER BY delivery, ts, event_id))
  SELECT event_id, user_id, event_type, day, delivery, ts, value, old_value, revision_flag, coalesce(ts < lim, false) AS late,
    {V.rnd('CASE WHEN old_value = 0 THEN 0 ELSE (value - old_value) / abs(old_value) * 100 END', 4)} AS revision_pct
  FROM w JOIN m ON delivery = md""")
def stream_late_revisions(spark, folder):
    """A tenth of the events arrives in a second delivery and a tenth in a third; all are published."""
    landing, out = fresh_path(spark, "late-landing"), fresh_path(spark, "late-out")
    late = F.when(F.col("event_id") % 10 == 0, 3).when(F.col("event_id") % 10 == 1, 2).otherwise(1).cast("bigint")
    events = table(spark, folder, "events").withColumn("delivery", late)
    for n in (1, 2, 3):
        events.filter(F.col("delivery") == n).write.mode("append").parquet(landing)
        jobs.published_revisions(spark, landing, out)
    return jobs.with_lateness(spark.read.parquet(f"{out}/published").drop("batch"))


@query("stream_rate_limit", sql=CATALOG["rate_limit_decisions"].sql)
def stream_rate_limit(spark, folder):
    hits = views.hits_from(runs.event_stream(spark, _events(folder)))
    return _plain_times(runs.drain_to_files(spark, stateful.limit_hits(hits), "stream-limits"), "hit_at")


@query("stream_block_ladder", uses=["blocks"], sql="""
  WITH r AS (SELECT *, row_number() OVER w AS block_count, lead(blocked_at) OVER w AS next_at FROM v_blocks WINDOW w AS (PARTITION BY source_url ORDER BY blocked_at, block_id)),
  b AS (SELECT *, block_count >= 3 AS is_permanent, CASE block_count WHEN 1 THEN blocked_at + INTERVAL 1 HOUR WHEN 2 THEN blocked_at + INTERVAL 4 HOUR END AS cooldown_until FROM r)
  SELECT 'block' AS kind, block_id, source_url, block_count, is_permanent, cooldown_until FROM b
  UNION ALL SELECT 'unblock', block_id, source_url, block_count, is_permanent, cooldown_until FROM b
  WHERE cooldown_until <= next_at OR (next_at IS NULL AND cooldown_until < (SELECT max(blocked_at) FROM v_blocks) - INTERVAL 1 HOUR)""")
def stream_block_ladder(spark, folder):
    """Blocks, and the ends of cooldowns that pass without another block."""
    blocks = views.blocks_from(runs.event_stream(spark, _events(folder)))
    return _plain_times(runs.drain_to_files(spark, stateful.escalate_blocks(blocks), "stream-blocks"), "cooldown_until")


_WATCHED = [(code, tier, K.SLA_WINDOW_MINUTES[tier]) for tier, codes in K.SLA_TIERS.items() for code in codes]
_START = "2024-01-01 00:00:00"


@query("stream_freshness", uses=["bronze"], sql=f"""
  WITH watched(indicator_code, tier, window_minutes) AS (VALUES {', '.join(str(w) for w in _WATCHED)}),
  ticks AS (SELECT unnest(range(TIMESTAMP '{_START}' + INTERVAL 4 HOUR, (SELECT max(crawled_at) FROM v_bronze) - INTERVAL 1 HOUR, INTERVAL 4 HOUR)) AS checked_at),
  c AS (SELECT indicator_code, crawled_at FROM v_bronze UNION ALL SELECT indicator_code, NULL FROM watched),
  a AS (SELECT w.indicator_code, tier, window_minutes, checked_at, max(crawled_at) FILTER (crawled_at <= checked_at) AS last_crawled_at
    FROM watched w CROSS JOIN ticks JOIN c USING (indicator_code) GROUP BY ALL)
  SELECT *, coalesce({V.rnd('epoch_us(checked_at - last_crawled_at) / 60e6', 2)}, -1) AS age_minutes,
    coalesce(epoch_us(checked_at - last_crawled_at) / 60e6 <= window_minutes, false) AS compliant FROM a""")
def stream_freshness(spark, folder):
    """Watched indicators every four hours, also those that nothing arrives for."""
    arrivals = views.bronze_from(runs.event_stream(spark, _events(folder))).select("indicator_code", "crawled_at")
    watched = spark.createDataFrame(_WATCHED, "indicator_code string, tier string, window_minutes int")
    checked = stateful.freshness(arrivals, watched, dt.datetime.fromisoformat(_START), 240)
    found = _plain_times(runs.drain_to_files(spark, checked, "stream-freshness"), "checked_at", "last_crawled_at")
    return found.withColumn("age_minutes", rnd("age_minutes", 2))


_CHANGES = """
  SELECT log_id, source_code, content_hash, CASE WHEN lag(content_hash) OVER (PARTITION BY source_code ORDER BY logged_at, log_id) = content_hash
    THEN 'SKIP' ELSE 'PROCEED' END AS decision FROM v_crawl_log"""


@query("stream_content_change", uses=["crawl_log"], sql=_CHANGES)
def stream_content_change(spark, folder):
    log = views.crawl_log_from(runs.event_stream(spark, _events(folder)))
    return runs.drain_to_files(spark, stateful.detect_changes(log), "stream-changes")


@query("stream_content_change_kept", uses=["crawl_log"], sql=_CHANGES)
def stream_content_change_kept(spark, folder):
    """The same through a kept table, with a source's rows split over tasks."""
    out = fresh_path(spark, "stream-changes-kept")
    jobs.content_changes(spark, _events(folder), out)
    found = spark.read.schema("log_id bigint, source_code bigint, content_hash string, decision string").parquet(f"{out}/changes")
    return found.drop("batch")
