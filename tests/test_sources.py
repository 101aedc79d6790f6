import pytest

from tessera.sources import files


def test_strict_csv(spark, tmp_path):
    names = ("Ministry", "Division", "Office", "Website_Link")
    good = tmp_path / "good.csv"
    good.write_text('Ministry,Division,Office,Website_Link\r\nB,B,B,http://b\r\nA,"A, x",A,http://a\r\n')
    rows = files.read_csv_strict(spark, str(good), names)
    assert rows.count() == 2
    files.write_csv_sorted(rows, str(tmp_path / "out"))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.startswith(b"Ministry,Division,Office,Website_Link\r\n") and b'A,"A, x",A,http://a\r\n' in text
    for bad in ("﻿Ministry,Division,Office,Website_Link\nA,A,A,u\n", "Ministry,Division\nA,A\n", "Ministry,Division,Office,Website_Link\nA,A,A,u\nA,A,A,v\n", "Ministry,Division,Office,Website_Link\nA,A,A\n"):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(ValueError):
            files.read_csv_strict(spark, str(tmp_path / "bad.csv"), names)


def test_tolerant_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Ministry Name,Office,E-mail\n M ,O\n,,\nN,P,a@b\n")
    rows = files.read_csv_tolerant(spark, str(tmp_path / "t.csv"), {"ministry": ("Ministry Name",), "office": (), "email": ("e mail",)}, ("ministry", "office"))
    assert sorted(tuple(r) for r in rows.collect()) == [("M", "O", None), ("N", "P", "a@b")]


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link>http://a</link><description>&lt;b&gt;x&lt;/b&gt; y</description></item><item><title>B</title></item></channel></rss>")
    assert [tuple(r) for r in files.read_feed(spark, str(tmp_path / "f.xml")).select("title", "link", "snippet").collect()] == [("A", "http://a", "x y")]


def test_json_array(spark, tmp_path):
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField("id", StringType())])
    (tmp_path / "a.json").write_text('[{"id": "1"}, {"id": "2"}]')
    (tmp_path / "b.json").write_text("[{")
    assert files.read_json_array(spark, str(tmp_path / "a.json"), schema).count() == 2
    assert files.read_json_array(spark, str(tmp_path / "b.json"), schema).count() == 0
