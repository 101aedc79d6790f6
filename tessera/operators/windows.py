"""Time windows, sessions by gap, rate limits, retention and recency, for batch tables.

``tessera.streaming`` has the same over streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tumbling(rows: DataFrame, ts: str, width: str, by: list[str], value: str) -> DataFrame:
    out = rows.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sliding(rows: DataFrame, ts: str, width: str, slide: str, by: list[str], value: str) -> DataFrame:
    out = rows.groupBy(F.window(ts, width, slide).alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def gap_sessions(rows: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Sessions of a key that end when nothing comes for ``gap_seconds``."""
    out = rows.groupBy(F.col(key).alias("key"), F.session_window(ts, f"{gap_seconds} seconds").alias("w")).agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count("*").alias("n"))
    return out.select("key", "session_start", "session_end", "n")


def over_limit(rows: DataFrame, key: str, ts: str, width: str, limit: int) -> DataFrame:
    """Fixed windows in which a key came more than ``limit`` times."""
    out = rows.groupBy(F.col(key).alias("key"), F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return out.select("key", F.col("w.start").alias("window_start"), "n")


def first_seen(rows: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(ts).alias("first_seen"), F.min_by(tie, F.struct(ts, tie)).alias("first_id"), F.count("*").alias("seen"))


def retained(rows: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Marks rows that a sweep at ``as_of`` keeps: those of the last ``days`` days."""
    return rows.where(F.col(ts).isNotNull()).withColumn("kept", F.col(ts) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def most_recent_keys(rows: DataFrame, key: str, ts: str, size: int) -> DataFrame:
    """What a cache of ``size`` keys holds when it evicts the least recently used."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.max(ts).alias("last_used")).orderBy(F.col("last_used").desc(), "key").limit(size)


def interleaved(rows: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """Round robin over groups: the first of each, then the second of each, up to ``limit`` rows."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    ranked = rows.select(F.col(group).alias("grp"), F.col(order).alias("id"), turn.cast("long").alias("turn")).where(F.col("turn") <= limit)
    return ranked.orderBy("turn", "grp").limit(limit)


def jumps(fixes: DataFrame, key: str, ts: str, order: str, most_seconds: int, most_metres: float) -> DataFrame:
    """Fixes (lat, lng) that lie over ``most_metres`` from the one before of the same key, less than ``most_seconds`` later."""
    from ..functions import geo

    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    w = Window.partitionBy(key).orderBy(ts, order)
    rows = fixes.withColumn("_lat", F.lag("lat").over(w)).withColumn("_lng", F.lag("lng").over(w)).withColumn("_us", micros(F.col(ts)) - micros(F.lag(ts).over(w)))
    rows = rows.withColumn("metres", F.round(geo.haversine_m(F.col("_lat"), F.col("_lng"), F.col("lat"), F.col("lng")), 1))
    out = rows.where((F.col("_us") > 0) & (F.col("_us") < 1000000 * most_seconds) & (F.col("metres") > most_metres))
    return out.select(F.col(key).alias("key"), F.col(order).alias("id"), "metres", F.round(F.col("_us") / 1000000.0, 3).alias("seconds"))
