"""Queries over attempts: errors among a user's events are failed attempts, all other events successes."""

from __future__ import annotations

from ..streaming import state


def retry_schedule(spark, sf_dir):
    """Attempts and retry times of every user."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return state.attempts(events, "user_id", "ts", "event_type", "event_id", ("error",))


RETRY_SCHEDULE = """
WITH o AS (
  SELECT user_id::VARCHAR AS key, ts, event_id, event_type AS status, event_type = 'error' AS bad,
    row_number() OVER w AS attempts, count(*) FILTER (event_type <> 'error' OR event_type IS NULL) OVER (w ROWS UNBOUNDED PRECEDING) AS ended,
    array_to_string(list(coalesce(event_type, '?')) OVER (w ROWS 2 PRECEDING), ',') AS recent, lead(ts) OVER w AS later
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, count(*) FILTER (bad) OVER (PARTITION BY key, ended ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM o),
r AS (SELECT *, ts + to_seconds([30, 120, 600][least(failures, 3)]) AS next_retry FROM f)
SELECT key, ts, 'seen' AS kind, status, attempts, failures, next_retry, recent FROM r
UNION ALL SELECT key, next_retry, 'due', status, attempts, failures, next_retry, recent FROM r WHERE next_retry IS NOT NULL AND (later IS NULL OR later > next_retry)
"""

QUERIES = {"retry_schedule": (retry_schedule, RETRY_SCHEDULE)}
