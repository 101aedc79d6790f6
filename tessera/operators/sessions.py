"""Session, visitor and audience aggregates over an activity log.

Every rollup combines before its shuffle and none needs all events of a session in one place: the per-session type summary
aggregates twice, by (session, type) and then by session, so that a session with many events sends few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def millis(ts: Column) -> Column:
    """Milliseconds since 1970, the nearest ones (halves away from 1970), for timestamps with and without a zone."""
    ts = ts.cast("timestamp")
    whole, micros = F.unix_millis(ts), F.unix_micros(ts)
    return whole + F.when(micros - 1000 * whole > F.when(micros < 0, 500).otherwise(499), 1).otherwise(0)


def two_places(c: Column) -> Column:
    """A number from 0 on to two places as doubles have it, so 1.005, which is a little less, becomes 1.0; ``round`` goes by its digits."""
    return F.floor(c * 100 + 0.5) / 100


def minutes_between(start: Column, end: Column) -> Column:
    return two_places((millis(end) - millis(start)) / F.lit(60000.0))


def session_rollup(events: DataFrame, session: str, kind: str, ts: str, event_id: str, value: str, page_kind: str = "view") -> DataFrame:
    """One row per session: span, page views, first value, and a summary of counts by type."""
    per_type = events.groupBy(F.coalesce(F.col(session).cast("string"), F.lit("unknown")).alias("session_id"), F.col(kind).alias("kind")).agg(
        F.count("*").alias("n"), F.min(ts).alias("t0"), F.max(ts).alias("t1"), F.min_by(value, F.struct(ts, event_id)).alias("v"), F.min(F.struct(ts, event_id)).alias("k")
    )
    return per_type.groupBy("session_id").agg(
        F.min("t0").alias("start_time"),
        F.max("t1").alias("end_time"),
        minutes_between(F.min("t0"), F.max("t1")).alias("duration_min"),
        F.sum("n").alias("activities"),
        F.sum(F.when(F.col("kind") == page_kind, F.col("n")).otherwise(0)).alias("page_views"),
        F.min_by("v", "k").alias("first_value"),
        F.concat_ws(", ", F.array_sort(F.collect_list(F.concat(F.coalesce("kind", F.lit("unknown")), F.lit(": "), F.col("n").cast("string"))))).alias("type_summary"),
    )


def type_breakdown(events: DataFrame, session: str, kind: str) -> DataFrame:
    """Counts of each type in a session and their share of the session in per cent."""
    counts = events.groupBy(F.col(session).alias("session_id"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("session_id").agg(F.sum("n").alias("total"))
    return counts.join(totals, "session_id").select("session_id", "kind", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))


def user_summary(events: DataFrame, user: str, kind: str, ts: str, page_kind: str = "view") -> DataFrame:
    """Totals per user over their days, a day standing for a session."""
    days = events.groupBy(F.col(user).alias("user"), F.to_date(ts).alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.col(kind) == page_kind).alias("views"), F.min(ts).alias("t0"), F.max(ts).alias("t1")
    )
    ms = millis(F.col("t1")) - millis(F.col("t0"))
    return days.groupBy("user").agg(
        F.count("*").alias("sessions"),
        F.sum("n").alias("activities"),
        F.sum("views").alias("page_views"),
        F.floor(F.sum(ms) / 3600000).cast("long").alias("hours"),
        (F.floor(F.sum(ms) / 60000) % 60).cast("long").alias("minutes"),
        two_places(F.sum("n") / F.count("*")).alias("per_session"),
    )


def visitors(events: DataFrame, user: str, kind: str, ts: str, event_id: str) -> DataFrame:
    """First and last visit, number of visits, and how the first one came."""
    return events.groupBy(F.col(user).alias("user")).agg(
        F.min(ts).alias("first_visit"), F.max(ts).alias("last_visit"), F.count("*").alias("visits"), F.min_by(kind, F.struct(ts, event_id)).alias("access_method")
    )


def success_rate(events: DataFrame, kind: str, failed: str = "error") -> DataFrame:
    return events.agg(
        F.count("*").alias("total"), F.count_if(F.col(kind) != failed).alias("succeeded"), F.round(100.0 * F.count_if(F.col(kind) != failed) / F.count("*"), 1).alias("success_pct"), F.countDistinct(kind).alias("kinds")
    )


def nearest_rank(events: DataFrame, group: str, value: str, share: float = 0.95) -> DataFrame:
    """Average and nearest-rank percentile of the positive values of each group."""
    return events.where(F.col(value) > 0).groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean_value"), F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})").alias("p_value"))


def capped_recent(rows: DataFrame, ts: str, key: str, limit: int) -> DataFrame:
    """The newest ``limit`` rows; ties by key, newest first.  A top-k: each task keeps ``limit`` rows at most."""
    return rows.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(limit)


def density(rows: DataFrame, lat: str, lng: str, label: str, order: str, limit: int = 500) -> DataFrame:
    """The ``limit`` fullest cells of hundredths of a degree, with the first row's label."""
    cells = rows.groupBy(F.round(lat, 2).alias("lat"), F.round(lng, 2).alias("lng")).agg(F.count("*").alias("n"), F.min_by(label, order).alias("first_label"))
    return cells.orderBy(F.col("n").desc(), "lat", "lng").limit(limit)
