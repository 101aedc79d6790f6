"""The directory file, CSV records by splits, and scored merges."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import directory, files, lines

NAMES = ("Ministry", "Division", "Office", "Website_Link")


def as_csv(rows):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\r\n").writerows(rows)
    return out.getvalue()


def table(n, seed):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(['a', 'খ', '"', ",", "\n", "\r\n", " ", "b"]) for _ in range(rng.randint(0, 12)))
    return [(f"M{rng.randrange(9)}{text()}", text(), f"O{i}", f"http://h/{i}" if i % 3 else "") for i in range(n)]


def test_one_sorted_file(spark, tmp_path):
    rows = table(300, 1)
    df = spark.createDataFrame(rows, files.schema_of(NAMES)).repartition(5)
    path = tmp_path / "d.csv"
    directory.write(df, str(path), copies=str(tmp_path / "copies"))
    want = as_csv([NAMES, *sorted(rows, key=lambda r: r[:3])])
    assert path.read_bytes().decode() == want
    assert [p.name for p in tmp_path.iterdir()] == ["d.csv"]  # no copy of a file that wasn't there, no parts
    directory.write(df.limit(0), str(path), copies=str(tmp_path / "copies"))
    assert path.read_bytes().decode() == as_csv([NAMES])
    assert [p.read_bytes().decode() for p in (tmp_path / "copies").iterdir()] == [want]


def test_a_write_that_fails_leaves_the_file(spark, tmp_path):
    schema = files.schema_of(NAMES)
    good = spark.createDataFrame([("A", "A", "A", "http://a"), ("B", "B", "B", "http://b")], schema)
    path = tmp_path / "d.csv"
    directory.write(good, str(path))
    before = path.read_bytes()
    for bad in ([("A", "A", "A", "x"), ("A", "A", "A", "y")], [("A", "A", "A", "http://A/"), ("B", "B", "B", " http://a")]):
        with pytest.raises(ValueError):
            directory.write(spark.createDataFrame(bad, schema), str(path))
    boom = F.udf(lambda x: 1 / 0 if x == "B" else x)
    with pytest.raises(Exception):  # a task fails: abort
        directory.write(good.withColumn("Division", boom("Division")), str(path), key=("Ministry",), link=None)
    writer = directory._Writer(str(path), list(NAMES), ["Ministry"], None)
    parts = [writer.write(iter([(n, "", "", "") for n in names])) for names in ("CA", "DB")]
    with pytest.raises(ValueError, match="overlap"):  # the commit fails
        writer.commit(parts)
    assert path.read_bytes() == before
    assert [p.name for p in tmp_path.iterdir()] == ["d.csv"]


def test_parts_that_changed(tmp_path):
    """A part that isn't what its task wrote, or is missing, stops the commit."""
    path = tmp_path / "d.csv"
    path.write_text("old")
    for spoil in (lambda w, m: open(m.path, "ab").write(b"x"), lambda w, m: None):
        writer = directory._Writer(str(path), ["a"], ["a"], None)
        part = writer.write(iter([("2",), ("1",), (None,)]))
        assert (part.first, part.last, part.rows) == (("",), ("2",), 3)
        changed = spoil(writer, part) is not None
        with pytest.raises(ValueError):
            writer.commit([part] if changed else [part, None])
        assert path.read_text() == "old" and [p.name for p in tmp_path.iterdir()] == ["d.csv"]


@pytest.mark.parametrize("split", [64, 300, 1 << 20])
def test_records_by_splits(spark, tmp_path, split):
    """Line breaks in quotes at the borders of splits: the rows of the csv module, in order."""
    for k in range(3):
        (tmp_path / f"{k}.csv").write_bytes(as_csv([("a", "b", "c", "d"), *table(60, k)]).encode())
    (tmp_path / "4.csv").write_bytes(b"")
    (tmp_path / "5.csv").write_bytes(b'a,b,c,d\n1,"x\n\ny",,""\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        schema = files.schema_of(("a", "b", "c", "d", "_bad"))
        rows = lines.read_csv(spark, str(tmp_path), schema).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for r in sorted(rows, key=lambda r: (r["file"], r["split"], r["place"])):
        assert r["_bad"] is None
        got.setdefault(r["file"].rsplit("/", 1)[-1], []).append(tuple(x or "" for x in (r["a"], r["b"], r["c"], r["d"])))
    fold = lambda rows: [tuple(x.replace("\r\n", "\n") for x in r) for r in rows]
    for k in range(3):
        assert fold(got[f"{k}.csv"]) == fold(table(60, k))
    assert got["5.csv"] == [("1", "x\n\ny", "", "")] and "4.csv" not in got


def test_scored_merge(spark):
    d = spark.createDataFrame([(1, "M", "Office A", "x@a", "1", "old"), (2, "M", "Office B", "x@a", "2", ""), (3, "N", "Office C", "", "3", "c"), (4, "N", "Office C", "", "4", "d")], "row long, ministry string, office string, email string, phone string, name string")
    u = spark.createDataFrame(
        [(10, "M", "Office B", "x@a", "1", "by identity"), (11, "M", "Other", "x@a", "1", "by score"), (12, "N", "Office C", "", "9", "two rows, no score"), (13, "Z", "New", "z@z", "", "new"), (14, "", "", "", "", "nothing"), (15, "M", "Office A", "", "", " ")],
        "id long, ministry string, office string, email string, phone string, name string",
    )
    rules = [(F.col("u_email") == F.col("d_email"), 100), (F.col("u_phone") == F.col("d_phone"), 60), (F.col("u_ministry") == F.col("d_ministry"), 20)]
    insert = (F.col("ministry") != "") & (F.col("office") != "") & (F.col("name") != "") & (F.col("email") != "")
    after, log = directory.merged(d, u, "row", "id", ["email", "phone", "office"], rules, ["name", "phone"], F.col("u_office") == F.col("d_office"), insert)
    assert {r["id"]: (r["row"], r["score"], r["action"]) for r in log.collect()} == {
        10: (2, 140.0, "updated"), 11: (1, 180.0, "updated"), 12: (None, None, "unmatched"), 13: (None, None, "inserted"), 14: (None, None, "unmatched"), 15: (1, 140.0, "updated"),
    }
    got = {(r["row"], r["office"]): (r["name"], r["phone"]) for r in after.collect()}
    assert got == {(1, "Office A"): ("by score", "1"), (2, "Office B"): ("by identity", "1"), (3, "Office C"): ("c", "3"), (4, "Office C"): ("d", "4"), (None, "New"): ("new", "")}
