"""Retries: the stream, stopped and started again, against the table, and the table against a plain loop."""

import datetime
import random

from tessera.streaming import state

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "id long, k string, t timestamp, s string"


def rows_of(n, seed):
    rng = random.Random(seed)
    times = sorted(rng.sample(range(9000), n))
    return [(i, rng.choice(["a", "a", "a", "b", "c", None]), T0 + datetime.timedelta(seconds=t), rng.choice(["failed", "failed", "blocked", "complete", None])) for i, t in enumerate(times)]


def by_hand(rows):
    out, held = [], {}
    for i, k, t, s in sorted(rows, key=lambda r: (r[2], r[0])):
        if k is None:
            continue
        status, n, fails, retry, recent = held.get(k, (None, 0, 0, None, []))
        if retry is not None and t > retry:
            out.append((k, retry, "due", status, n, fails, retry, ",".join(recent)))
        fails = fails + 1 if s in ("failed", "blocked") else 0
        retry = t + datetime.timedelta(seconds=state.WAITS[min(fails, 3) - 1]) if fails else None
        recent = [*recent, s or "?"][-state.RECENT :]
        held[k] = (s, n + 1, fails, retry, recent)
        out.append((k, t, "seen", s, n + 1, fails, retry, ",".join(recent)))
    return out + [(k, r, "due", s, n, f, r, ",".join(x)) for k, (s, n, f, r, x) in held.items() if r is not None]


def test_table_by_hand(spark):
    rows = rows_of(150, 3) + [(1000, "a", None, "failed")]
    out = state.attempts(spark.createDataFrame(rows, SCHEMA).repartition(3), "k", "t", "s", "id", ("failed", "blocked"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(by_hand([r for r in rows if r[2]]), key=str)
    assert state.attempts(spark.createDataFrame([], SCHEMA), "k", "t", "s", "id", ("failed",)).count() == 0


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Three runs of one query, each over new files; state and timers of the last run are there in the next."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = rows_of(120, 4)
    seen = 0
    for begin, end in ((0, 50), (50, 51), (51, 120)):
        spark.createDataFrame(rows[begin:end], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = state.retries(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "k", "t", "s", "id", ("failed", "blocked"))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        n = spark.read.parquet(str(tmp_path / "out")).count()
        assert n > seen
        seen = n
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert len(got) == len(set(got))
    last = rows[-1][2]
    want = set(by_hand(rows))
    assert set(got) <= want
    # Only retry times that the watermark hasn't passed may be open.
    assert all(r[2] == "due" and r[1] >= last - datetime.timedelta(seconds=1) for r in want - set(got))
