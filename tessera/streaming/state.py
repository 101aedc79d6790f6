"""Retries of rows as a stream: each row's attempts, failures in turn and retry time are kept in state, and a timer tells when it is due again.

``attempts`` does the same for a table, by windows.  Both give a row for each attempt (``kind`` seen) and one for each retry time that passes
without an attempt (``kind`` due).  The stream gives a due row when its watermark has passed the retry time, or the next attempt came later than
it.  A restarted stream goes on from its checkpoint.

Defined cases: attempts of a key in one batch are taken in order of time, then of ``tie``; an attempt that comes later but is older than the last
one counts, and leaves status and retry time as they are; a success ends the failures; after the longest wait the wait stays; rows without key or
time are left out; an empty stream gives nothing.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds to wait after the first, second and further failures.
WAITS = (30, 120, 600)
#: Attempts that a row remembers.
RECENT = 3
_OUT = "key string, ts timestamp, kind string, status string, attempts long, failures long, next_retry timestamp, recent string"
_EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)


def wait_of(failures: Column) -> Column:
    """Seconds to wait after so many failures in turn; null after none."""
    out = F.when(failures == 0, F.lit(None))
    for i, s in enumerate(WAITS[:-1], 1):
        out = out.when(failures == i, F.lit(s))
    return out.otherwise(F.lit(WAITS[-1]))


def attempts(events: DataFrame, key: str, ts: str, status: str, tie: str, failed: tuple[str, ...]) -> DataFrame:
    """Seen and due rows of a whole table of attempts."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.col(status).alias("status"), F.col(tie).alias("tie")).where("key IS NOT NULL AND ts IS NOT NULL")
    order = Window.partitionBy("key").orderBy("ts", "tie")
    bad = F.col("status").isin(*failed)
    rows = rows.withColumns({"attempts": F.row_number().over(order).cast("long"), "ended": F.sum(F.when(F.coalesce(bad, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    in_turn = Window.partitionBy("key", "ended").orderBy("ts", "tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("failures", F.sum(F.when(F.coalesce(bad, F.lit(False)), 1).otherwise(0)).over(in_turn))
    rows = rows.withColumn("next_retry", F.timestamp_add("SECOND", wait_of(F.col("failures")), F.col("ts")))
    rows = rows.withColumns({"recent": F.array_join(F.collect_list(F.coalesce("status", F.lit("?"))).over(order.rowsBetween(1 - RECENT, 0)), ","), "later": F.lead("ts").over(order)})
    names = ["key", "ts", "kind", "status", "attempts", "failures", "next_retry", "recent"]
    seen = rows.withColumn("kind", F.lit("seen")).select(*names)
    due = rows.where(F.col("next_retry").isNotNull() & (F.col("later").isNull() | (F.col("later") > F.col("next_retry")))).withColumns({"kind": F.lit("due"), "ts": F.col("next_retry")})
    return seen.unionByName(due.select(*names))


class _Attempts(StatefulProcessor):
    """Value state: status, attempts, failures, last attempt, retry time (ms); list state: the statuses of the last attempts."""

    def __init__(self, failed: tuple[str, ...], waits: tuple[int, ...], recent: int):
        self.failed, self.waits, self.most = failed, waits, recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", "status string, attempts long, failures long, last long, retry long")
        self.recent = handle.getListState("recent", "status string")

    @staticmethod
    def _at(ms: int | None) -> datetime.datetime | None:
        return None if ms is None else (_EPOCH + datetime.timedelta(microseconds=ms)).astimezone().replace(tzinfo=None)

    def _out(self, key: str, at: int, kind: str, state: tuple, recent: list[str]) -> Row:
        status, n, failures, _, retry = state
        return Row(key=key, ts=self._at(at), kind=kind, status=status, attempts=n, failures=failures, next_retry=self._at(retry), recent=",".join(recent))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self.row.get() if self.row.exists() else (None, 0, 0, None, None)
        recent = [x[0] for x in self.recent.get()] if self.recent.exists() else []
        micros = lambda t: (t.astimezone(datetime.UTC) - _EPOCH) // datetime.timedelta(microseconds=1)
        timers, fresh = set(self.handle.listTimers()), False
        for r in sorted(rows, key=lambda r: (r.ts, r.tie)):
            at = micros(r.ts)
            status, n, failures, last, retry = state
            if retry is not None and at > retry and (fresh or self._timer(retry) in timers):  # else the timer has told it
                yield self._out(key[0], retry, "due", state, recent)
            if last is not None and at < last:  # an older attempt
                state = (status, n + 1, failures, last, retry)
            else:
                failures = failures + 1 if r.status in self.failed else 0
                retry = at + 1_000_000 * self.waits[min(failures, len(self.waits)) - 1] if failures else None
                state = (r.status, n + 1, failures, at, retry)
                recent = [*recent, "?" if r.status is None else r.status][-self.most :]
                fresh = True
            yield self._out(key[0], at, "seen", state, recent)
        for t in timers:
            self.handle.deleteTimer(t)
        if state[4] is not None and (fresh or timers):
            self.handle.registerTimer(self._timer(state[4]))
        self.row.update(state)
        self.recent.put([(x,) for x in recent])

    @staticmethod
    def _timer(retry: int) -> int:
        return -(-retry // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.row.get()
        if state[4] is not None and self._timer(state[4]) == expiredTimerInfo.getExpiryTimeInMs():
            yield self._out(key[0], state[4], "due", state, [x[0] for x in self.recent.get()])

    def close(self) -> None:
        pass


def retries(events: DataFrame, key: str, ts: str, status: str, tie: str, failed: tuple[str, ...], late: str = "0 seconds") -> DataFrame:
    """As ``attempts``, of a stream; attempts over ``late`` behind are dropped.  Needs the RocksDB state store."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.col(status).alias("status"), F.col(tie).alias("tie")).where("key IS NOT NULL AND ts IS NOT NULL")
    return rows.withWatermark("ts", late).groupBy("key").transformWithState(_Attempts(failed, WAITS, RECENT), _OUT, "append", "eventTime")
