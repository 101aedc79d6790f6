"""Structured Streaming over activity events, feeds and position fixes.

Every job takes a streaming DataFrame and returns one; the caller picks source, sink and trigger.  State is bounded by watermarks or
timeouts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_counts(events: DataFrame, ts: str, by: list[str], late: str = "1 day") -> DataFrame:
    """Counts of each UTC day; events later than ``late`` are dropped and a day is emitted once it is over."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), *by, "n")


def sliding_counts(events: DataFrame, ts: str, width: str, slide: str, by: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def gap_sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return out.select("key", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def over_limit(events: DataFrame, key: str, ts: str, width: str = "300 minutes", limit: int = 4000, late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return out.where(F.col("n") > limit).select("key", F.col("w.start").alias("window_start"), "n")


def exploded_batches(batches: DataFrame, items: str) -> DataFrame:
    """A row per event of a batch message."""
    return batches.select(*[c for c in batches.columns if c != items], F.explode(items).alias("event")).select("*", "event.*").drop("event")


def first_items(feed: DataFrame, key: str, ts: str, late: str = "20 days") -> DataFrame:
    """Feed items by key, the first of each; keys are forgotten ``late`` after their time."""
    return feed.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


_FIX = "key string, ts timestamp, lat double, lng double, verdict string"


def _metres(a: float, b: float, c: float, d: float) -> float:
    from math import asin, cos, radians, sin, sqrt

    h = sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2
    return 2 * 6371000.0 * asin(min(1.0, sqrt(h)))


def checked_fixes(fixes: DataFrame, window_s: float = 60, most_m: float = 1000, most_accuracy: float = 30, forget_ms: int = 86_400_000) -> DataFrame:
    """fixes (key, ts, lat, lng, accuracy) with a verdict: invalid, jump or accepted.

    A jump lies over ``most_m`` from the key's last accepted fix, less than ``window_s`` later.  A rejected fix doesn't become the last
    one.  Fixes of one key in a batch are judged in order of time; the state is one fix a key.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "lat", "lng"])
        out = []
        for r in rows.itertuples(index=False):
            ok = -90 <= r.lat <= 90 and -180 <= r.lng <= 180 and not (r.lat == 0 and r.lng == 0) and 0 < r.accuracy <= most_accuracy
            at = r.ts.timestamp()
            verdict = "accepted" if ok else "invalid"
            if ok and last is not None and 0 < at - last[0] < window_s and _metres(last[1], last[2], r.lat, r.lng) > most_m:
                verdict = "jump"
            if verdict == "accepted":
                last = (at, r.lat, r.lng)
            out.append((r.key, r.ts, r.lat, r.lng, verdict))
        if last is not None:
            state.update(last)
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(out, columns=["key", "ts", "lat", "lng", "verdict"])

    return fixes.groupBy("key").applyInPandasWithState(judge, _FIX, "at double, lat double, lng double", "append", GroupStateTimeout.ProcessingTimeTimeout)
