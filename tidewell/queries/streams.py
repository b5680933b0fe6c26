"""Streaming jobs, run as streams to the end of the events table; the SQL is their batch meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.operators.graph import shared_path
from tidewell.queries import query
from tidewell.streaming import jobs


def _add(name: str, build: Callable[[DataFrame], DataFrame], mode: str, sql: str | None, select: list[str]) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return jobs.run_once(build(jobs.source(spark, sf_dir)), mode, shared_path(spark)).selectExpr(*select)


_add("R1_write_rate", jobs.write_rate, "complete", "SELECT user_id, CAST(epoch(s) AS BIGINT) AS start_s, count(*) AS n FROM (SELECT user_id, unnest([to_timestamp(floor(epoch(ts) / 10) * 10 - 10 * k) FOR k IN range(6)]) AS s FROM events) x GROUP BY user_id, s", ["user_id", "unix_seconds(start) AS start_s", "n"])
_add(
    "R1_rate_limiter",
    lambda e: jobs.rate_limiter(e, 3, 86_400.0),
    "append",
    # The newest times that were let through go along in the order of a user's events.
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    f AS (SELECT user_id, event_id, rn, true AS accepted, [us] AS held FROM e WHERE rn = 1
      UNION ALL SELECT e.user_id, e.event_id, e.rn, len(list_filter(f.held, lambda h: h > e.us - 86400000000)) < 3, CASE WHEN len(list_filter(f.held, lambda h: h > e.us - 86400000000)) < 3 THEN list_append(list_filter(f.held, lambda h: h > e.us - 86400000000), e.us) ELSE f.held END
      FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
    SELECT user_id, event_id, accepted FROM f""",
    ["*"],
)
_add("R2_reinforcement", lambda e: jobs.access_reinforcement(e, 3), "append", "WITH RECURSIVE e AS (SELECT event_id, event_id % 3 AS id, ts FROM events), c AS (SELECT id, min(ts) AS ts FROM e GROUP BY id UNION ALL SELECT c.id, min(e.ts) FROM c JOIN e ON e.id = c.id AND e.ts >= c.ts + INTERVAL 300 SECOND GROUP BY c.id) SELECT e.id, e.event_id, c.ts IS NOT NULL AS counted FROM e LEFT JOIN c USING (id, ts)", ["*"])
_add(
    "R2_flush",
    lambda e: jobs.access_flush(e, 3),
    "append",
    """WITH RECURSIVE e AS (SELECT event_id % 3 AS id, ts FROM events), c AS (SELECT id, min(ts) AS ts FROM e GROUP BY id UNION ALL SELECT c.id, min(e.ts) FROM c JOIN e ON e.id = c.id AND e.ts >= c.ts + INTERVAL 300 SECOND GROUP BY c.id)
    SELECT id, 1 AS accesses, epoch_us(ts) + 5000000 AS flushed_us FROM (SELECT *, lead(ts) OVER (PARTITION BY id ORDER BY ts) AS after FROM c) x WHERE after IS NOT NULL OR epoch_us(ts) + 5000000 < (SELECT max(epoch_us(ts)) FROM events) - 3600000000""",
    ["*"],
)
_add("R3_hit_counters", jobs.hit_counters, "complete", "SELECT event_id % 100 AS id, count(*) AS hits, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1", ["id", "hits", "unix_micros(cast(last_hit AS timestamp)) AS last_us"])
_add("R4_once_per_session", jobs.once_per_session, "append", "SELECT DISTINCT user_id % 50 AS session, event_type FROM events", ["*"])
_add("R6_heartbeats", jobs.heartbeats, "complete", "SELECT event_type AS source, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1", ["source", "unix_micros(cast(last AS timestamp)) AS last_us"])
_add("R7_health_windows", jobs.health_windows, "complete", "SELECT CAST(s AS BIGINT) AS start_s, count(*) AS total, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failures FROM (SELECT event_type, unnest([floor(epoch(ts) / 86400) * 86400 - 86400 * k FOR k IN range(7)]) AS s FROM events) x GROUP BY s", ["unix_seconds(start) AS start_s", "total", "failures"])
_add("R9_sessions", jobs.sessions, "complete", "SELECT user_id, CAST(min(epoch_us(ts)) AS BIGINT) AS start_us, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS b FROM events) x) y GROUP BY user_id, s", ["user_id", "unix_micros(cast(start AS timestamp)) AS start_us", "n"])
_add("R5_dream_trigger", lambda e: jobs.scopes_due(e.where("event_type <> 'error'"), "user_id", 50), "complete", "SELECT user_id AS scope, count(*) AS writes FROM events WHERE event_type <> 'error' GROUP BY user_id HAVING count(*) >= 50", ["*"])
