"""Readers and writers of files: strict and tolerant CSV, JSON, feeds, text exports, replacement by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import text as T

ROLES = ("Primary", "Alternate", "Appellate")
KEY = ("Ministry", "Division", "Office")
ROLE_FIELDS = ("Officer_Name", "Designation", "Phone", "Mobile", "Email", "Address", "Image_URL")
#: The directory's 26 columns, in order.
DIRECTORY = (*KEY, *(f"{r}_{f}" for r in ROLES for f in ROLE_FIELDS), "Website_Link", "Last_Updated")


def schema_of(names: tuple[str, ...]) -> ST.StructType:
    return ST.StructType([ST.StructField(n, ST.StringType()) for n in names])


def read_csv_strict(spark: SparkSession, path: str, names: tuple[str, ...] = DIRECTORY, key: tuple[str, ...] = KEY) -> DataFrame:
    """A CSV file with exactly this header, this many fields in every row and a unique key; anything else raises ValueError."""
    header = spark.read.text(path).limit(1).first()
    marked = spark.read.format("binaryFile").load(path).where(F.hex(F.substring("content", 1, 3)) == "EFBBBF")  # the text reader drops the mark
    if header is None or not marked.isEmpty() or header[0].rstrip("\r") != ",".join(names):
        raise ValueError("the header differs")
    rows = spark.read.csv(path, schema=schema_of((*names, "_bad")), header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema=True)
    rows = rows.cache()
    try:
        if not rows.where(F.col("_bad").isNotNull()).isEmpty():
            raise ValueError("a row has another number of fields")
        if not rows.groupBy(*key).count().where("count > 1").isEmpty():
            raise ValueError("the key is not unique")
    finally:
        rows.unpersist()
    return rows.drop("_bad").na.fill("")


def read_csv_tolerant(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]], required: tuple[str, ...]) -> DataFrame:
    """A CSV file with headers by any of their aliases; ragged rows are tolerated, values trimmed, and rows without any of ``required`` dropped."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    canonical = lambda s: "_".join(x for x in "".join(c if c.isalnum() else " " for c in s.lstrip("﻿").lower()).split())
    have = {}
    for c in raw.columns:
        have.setdefault(canonical(c), c)
    pick = lambda names: T.first_filled(*[F.col(f"`{have[canonical(n)]}`") for n in names if canonical(n) in have]) if any(canonical(n) in have for n in names) else F.lit(None).cast("string")
    rows = raw.select(*[pick((k, *v)).alias(k) for k, v in aliases.items()])
    return rows.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in required]))


def write_csv_sorted(rows: DataFrame, path: str, key: tuple[str, ...] = KEY, unique: str | None = "Website_Link") -> None:
    """Sorted by key in code-point order, CRLF line ends; refuses repeated values of ``unique``.

    Files are range partitions in order, so that their concatenation is the sorted table whatever its size.
    """
    if unique and not rows.where(T.blank_to_null(F.col(unique)).isNotNull()).groupBy(unique).count().where("count > 1").isEmpty():
        raise ValueError(f"{unique} is not unique")
    rows.orderBy(*key).write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("emptyValue", "").option("escape", '"').csv(path)


def write_csv_quoted(rows: DataFrame, path: str, lists: tuple[str, ...] = ()) -> None:
    """All fields quoted, lists joined by semicolons."""
    out = rows.select(*[F.array_join(c, ";").alias(c) if c in lists else F.col(c) for c in rows.columns])
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_json_array(spark: SparkSession, path: str, schema: ST.StructType) -> DataFrame:
    """A file that is one JSON array; a corrupt file gives no rows."""
    return spark.read.json(path, schema=schema, multiLine=True, mode="DROPMALFORMED")


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_feed(spark: SparkSession, path: str, most_chars: int = 250) -> DataFrame:
    """Items of RSS files and entries of Atom files: title, link, snippet, published; those without title or link are dropped."""
    text = ST.StringType()
    rss = ST.StructType([ST.StructField(n, text) for n in ("title", "link", "description", "pubDate")])
    link = ST.StructType([ST.StructField("_href", text)])
    atom = ST.StructType([ST.StructField("title", text), ST.StructField("link", link), ST.StructField("summary", text), ST.StructField("updated", text)])
    items = spark.read.format("xml").schema(rss).option("rowTag", "item").load(path).select("title", "link", F.col("description").alias("snippet"), F.col("pubDate").alias("published"))
    entries = spark.read.format("xml").schema(atom).option("rowTag", "entry").load(path).select("title", F.col("link._href").alias("link"), F.col("summary").alias("snippet"), F.col("updated").alias("published"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("snippet", "<[^>]+>", " "), r"\s+", " "))
    out = items.unionByName(entries).select(F.trim("title").alias("title"), F.trim("link").alias("link"), F.substring(plain, 1, most_chars).alias("snippet"), F.trim("published").alias("published"))
    return out.where((F.length("title") > 0) & (F.length("link") > 0))


def officers_long(directory: DataFrame) -> DataFrame:
    """The directory as (key columns, role, field, value), blanks left out."""
    cells = [F.struct(F.lit(r.lower()).alias("role"), F.lit(f.lower()).alias("field"), F.col(f"{r}_{f}").alias("value")) for r in ROLES for f in ROLE_FIELDS]
    return directory.select(*KEY, F.explode(F.array(*cells)).alias("x")).select(*KEY, "x.*").where(T.blank_to_null(F.col("value")).isNotNull())
