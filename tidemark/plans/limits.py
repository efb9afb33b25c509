"""Rate-limit queries."""

from __future__ import annotations

from tidemark.operators import limits as L
from tidemark.plans.catalog import query
from tidemark.sources import views


@query("rate_limit_decisions", uses=["hits"], sql="""
  WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY hit_at, hit_id) AS n,
      CASE role WHEN 'PUBLIC' THEN 2 WHEN 'EXTERNAL_BUSINESS' THEN 10 ELSE 999 END AS burst,
      CASE role WHEN 'PUBLIC' THEN 10 WHEN 'EXTERNAL_BUSINESS' THEN 1000 ELSE 999999 END AS daily FROM v_hits),
  fold AS (
    SELECT hit_id, identifier, role, hit_at, n, burst, daily, hit_at AS opened, CAST(1 AS BIGINT) AS used, CAST(1 AS BIGINT) AS passed, true AS allowed FROM h WHERE n = 1
    UNION ALL
    SELECT hit_id, identifier, role, hit_at, n, burst, daily, opened, used + CAST(ok AS BIGINT), passed + CAST(ok AS BIGINT), ok FROM (
      SELECT *, used < daily AND passed < burst AS ok FROM (
        SELECT h.hit_id, h.identifier, h.role, h.hit_at, h.n, h.daily, h.burst,
          CASE WHEN h.hit_at - f.opened >= INTERVAL 1 MINUTE THEN h.hit_at ELSE f.opened END AS opened,
          CASE WHEN CAST(h.hit_at AS DATE) = CAST(f.hit_at AS DATE) THEN f.used ELSE 0 END AS used,
          CASE WHEN h.hit_at - f.opened >= INTERVAL 1 MINUTE THEN 0 ELSE f.passed END AS passed
        FROM fold f JOIN h ON h.identifier = f.identifier AND h.n = f.n + 1)))
  SELECT hit_id, identifier, role, hit_at, allowed, greatest(0, daily - used) AS daily_remaining, greatest(0, burst - passed) AS minute_remaining,
    CASE WHEN allowed THEN NULL WHEN used >= daily THEN epoch_us(date_trunc('day', hit_at) + INTERVAL 1 DAY - hit_at) // 1000000
      ELSE greatest(1, epoch_us(opened + INTERVAL 1 MINUTE - hit_at) // 1000000) END AS retry_after FROM fold""")
def rate_limit_decisions(spark, folder):
    """Hits at their own times; the check walks every identifier hit by hit."""
    return L.decide(views.hits(spark, folder))
