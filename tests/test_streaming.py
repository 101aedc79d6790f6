import datetime

from tessera.streaming import jobs


def run(spark, tmp_path, df, job, schema, name, mode="append"):
    df.write.parquet(str(tmp_path / "in"))
    stream = job(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_fixes(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    s = datetime.timedelta(seconds=1)
    rows = [("a", t, 23.7, 90.4, 5.0), ("a", t + 10 * s, 24.7, 90.4, 5.0), ("a", t + 20 * s, 23.7001, 90.4, 5.0), ("a", t + 90 * s, 24.7, 90.4, 5.0), ("b", t, 0.0, 0.0, 5.0), ("b", t + s, 1.0, 1.0, 31.0)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, lat double, lng double, accuracy double")
    got = sorted((r.key, r.ts, r.verdict) for r in run(spark, tmp_path, df.coalesce(1), jobs.checked_fixes, df.schema, "fixes"))
    assert [v for _, _, v in got] == ["accepted", "jump", "accepted", "accepted", "invalid", "invalid"]


def test_daily(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, "x"), (t, "x"), (t + datetime.timedelta(1), "y")], "ts timestamp, kind string")
    got = run(spark, tmp_path, df, lambda d: jobs.daily_counts(d, "ts", ["kind"]), df.schema, "daily", "complete")
    assert sorted((r.kind, r.n) for r in got) == [("x", 2), ("y", 1)]


def test_first_items(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([("u", t), ("u", t), ("v", t)], "url string, ts timestamp")
    assert len(run(spark, tmp_path, df, lambda d: jobs.first_items(d, "url", "ts"), df.schema, "items")) == 2
