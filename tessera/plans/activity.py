"""Queries over the activity log: rollups, audiences, percentiles, windows and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions, windows


def _table(name):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


_events, _customer, _orders = _table("events"), _table("customer"), _table("orders")


def session_rollup(spark, sf_dir):
    return sessions.session_rollup(_events(spark, sf_dir), "user_id", "event_type", "ts", "event_id", "value")


def session_type_breakdown(spark, sf_dir):
    return sessions.type_breakdown(_events(spark, sf_dir), "user_id", "event_type")


def user_master_summary(spark, sf_dir):
    return sessions.user_summary(_events(spark, sf_dir), "user_id", "event_type", "ts")


def visitor_summary(spark, sf_dir):
    return sessions.visitors(_events(spark, sf_dir), "user_id", "event_type", "ts", "event_id")


def overview_success_rate(spark, sf_dir):
    return sessions.success_rate(_events(spark, sf_dir), "event_type")


def processing_p95(spark, sf_dir):
    return sessions.nearest_rank(_events(spark, sf_dir), "event_type", "value")


def bucket_density(spark, sf_dir):
    points = _customer(spark, sf_dir).withColumn("lat", 20.0 + (F.col("c_custkey") * 7 % 600) / 100.0).withColumn("lng", 88.0 + (F.col("c_custkey") * 13 % 400) / 100.0)
    return sessions.density(points, "lat", "lng", "c_mktsegment", "c_custkey")


def capped_recent(spark, sf_dir):
    return sessions.capped_recent(_orders(spark, sf_dir), "o_orderdate", "o_orderkey", 250).select("o_orderkey", "o_orderdate", "o_totalprice")


def paged_sorted(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    page = rows.orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_orderdate")
    return page.join(F.broadcast(rows.agg(F.count("*").alias("total"))), how="inner").withColumn("has_more", F.col("total") > 150)  # one row is broadcast


def merged_activity_feed(spark, sf_dir):
    a = _events(spark, sf_dir).select("ts", F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("kind"))
    b = _orders(spark, sf_dir).select(F.col("o_orderdate").alias("ts"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderstatus").alias("kind"))
    return a.unionByName(b).orderBy(F.col("ts").desc(), "id").limit(300)


def daily_tumbling(spark, sf_dir):
    return windows.tumbling(_events(spark, sf_dir), "ts", "1 day", ["event_type"], "value")


def sliding_activity(spark, sf_dir):
    return windows.sliding(_events(spark, sf_dir), "ts", "2 hours", "1 hour", ["event_type"], "value")


def gap_sessions(spark, sf_dir):
    return windows.gap_sessions(_events(spark, sf_dir), "user_id", "ts", 24 * 3600)


def rate_limit_windows(spark, sf_dir):
    return windows.over_limit(_events(spark, sf_dir), "user_id", "ts", "300 minutes", 2)


def dedupe_by_key_first_seen(spark, sf_dir):
    return windows.first_seen(_events(spark, sf_dir), ["user_id", "event_type"], "ts", "event_id")


def retention_sweep(spark, sf_dir):
    return windows.retained(_events(spark, sf_dir), "ts", "2024-02-01 00:00:00", 15).groupBy("kept").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))


def lru_keep(spark, sf_dir):
    return windows.most_recent_keys(_events(spark, sf_dir), "user_id", "ts", 50)


def events_json_props(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("top"))


def round_robin_sample(spark, sf_dir):
    return windows.interleaved(_events(spark, sf_dir), "event_type", "event_id", 40)


QUERIES = {
    "session_rollup": (
        session_rollup,
        """
        WITH k AS (
          SELECT coalesce(CAST(user_id AS VARCHAR), 'unknown') AS session_id, coalesce(event_type, 'unknown') AS kind, count(*) AS n
          FROM events GROUP BY ALL),
        s AS (
          SELECT session_id, string_agg(kind || ': ' || n, ', ' ORDER BY kind || ': ' || n) AS type_summary FROM k GROUP BY session_id)
        SELECT coalesce(CAST(user_id AS VARCHAR), 'unknown') AS session_id, min(ts) AS start_time, max(ts) AS end_time,
               round((epoch_ms(max(ts)) - epoch_ms(min(ts))) / 60000.0, 2) AS duration_min, count(*) AS activities,
               count(*) FILTER (event_type = 'view') AS page_views, arg_min(value, (ts, event_id)) AS first_value, any_value(s.type_summary) AS type_summary
        FROM events JOIN s ON s.session_id = coalesce(CAST(user_id AS VARCHAR), 'unknown')
        GROUP BY 1
        """,
    ),
    "session_type_breakdown": (
        session_type_breakdown,
        """
        SELECT user_id AS session_id, event_type AS kind, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY user_id), 1) AS pct
        FROM events GROUP BY 1, 2
        """,
    ),
    "user_master_summary": (
        user_master_summary,
        """
        WITH d AS (
          SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'view') AS views, epoch_ms(max(ts)) - epoch_ms(min(ts)) AS ms
          FROM events GROUP BY 1, 2)
        SELECT user_id AS "user", count(*) AS sessions, CAST(sum(n) AS BIGINT) AS activities, CAST(sum(views) AS BIGINT) AS page_views,
               CAST(floor(sum(ms) / 3600000) AS BIGINT) AS hours, CAST(floor(sum(ms) / 60000) % 60 AS BIGINT) AS minutes, round(sum(n) / count(*), 2) AS per_session
        FROM d GROUP BY 1
        """,
    ),
    "visitor_summary": (
        visitor_summary,
        """
        SELECT user_id AS "user", min(ts) AS first_visit, max(ts) AS last_visit, count(*) AS visits, arg_min(event_type, (ts, event_id)) AS access_method
        FROM events GROUP BY 1
        """,
    ),
    "overview_success_rate": (
        overview_success_rate,
        """
        SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 1) AS success_pct,
               count(DISTINCT event_type) AS kinds FROM events
        """,
    ),
    "processing_p95": (
        processing_p95,
        """
        SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_value, quantile_disc(value, 0.95) AS p_value FROM events WHERE value > 0 GROUP BY 1
        """,
    ),
    "bucket_density": (
        bucket_density,
        """
        WITH p AS (SELECT *, round(20.0 + (c_custkey * 7 % 600) / 100.0, 2) AS lat, round(88.0 + (c_custkey * 13 % 400) / 100.0, 2) AS lng FROM customer)
        SELECT CAST(lat AS DOUBLE) AS lat, CAST(lng AS DOUBLE) AS lng, count(*) AS n, arg_min(c_mktsegment, c_custkey) AS first_label
        FROM p GROUP BY 1, 2 ORDER BY n DESC, lat, lng LIMIT 500
        """,
    ),
    "capped_recent": (capped_recent, "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 250"),
    "paged_sorted": (
        paged_sorted,
        """
        WITH p AS (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100)
        SELECT p.*, (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders) > 150 AS has_more FROM p
        """,
    ),
    "merged_activity_feed": (
        merged_activity_feed,
        """
        SELECT * FROM (
          SELECT ts, 'event:' || event_id AS id, event_type AS kind FROM events
          UNION ALL SELECT o_orderdate, 'order:' || o_orderkey, o_orderstatus FROM orders)
        ORDER BY ts DESC, id LIMIT 300
        """,
    ),
    "daily_tumbling": (
        daily_tumbling,
        """
        SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2
        """,
    ),
    "sliding_activity": (
        sliding_activity,
        """
        SELECT window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (
          SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL '1 hour']) AS window_start, event_type, value FROM events)
        GROUP BY 1, 2
        """,
    ),
    "gap_sessions": (
        gap_sessions,
        """
        WITH f AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 86400 THEN 0 ELSE 1 END AS is_new FROM events),
        s AS (SELECT user_id, ts, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
        SELECT user_id AS key, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM s GROUP BY user_id, k
        """,
    ),
    "rate_limit_windows": (
        rate_limit_windows,
        """
        SELECT user_id AS key, time_bucket(INTERVAL '300 minutes', ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 2
        """,
    ),
    "dedupe_by_key_first_seen": (
        dedupe_by_key_first_seen,
        """
        SELECT user_id, event_type, min(ts) AS first_seen, arg_min(event_id, (ts, event_id)) AS first_id, count(*) AS seen FROM events GROUP BY 1, 2
        """,
    ),
    "retention_sweep": (
        retention_sweep,
        """
        SELECT ts >= TIMESTAMP '2024-02-01' - INTERVAL '15 days' AS kept, count(*) AS n, min(ts) AS oldest FROM events WHERE ts IS NOT NULL GROUP BY 1
        """,
    ),
    "lru_keep": (
        lru_keep,
        """
        SELECT user_id AS key, max(ts) AS last_used FROM events GROUP BY 1 ORDER BY last_used DESC, key LIMIT 50
        """,
    ),
    "events_json_props": (
        events_json_props,
        """
        SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS top
        FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1
        """,
    ),
    "round_robin_sample": (
        round_robin_sample,
        """
        WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn FROM events)
        SELECT event_type AS grp, event_id AS id, turn FROM r ORDER BY turn, event_type LIMIT 40
        """,
    ),
}
