"""CSV files with line breaks inside quoted fields, read by many tasks.

Spark reads such a file in one task, as a split may begin inside a quoted field.  Here lines are read as text, by splits.  Whether a line begins
inside quotes is the parity of the quotes before it: within its split by a running sum, and before its split by the sums of the splits
before, a row a split.  A line that begins outside quotes begins a record.  Records of one line, nearly all, are parsed where they are; the lines
of others are put together first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, split, place, record: the records of CSV files, each as it stands in the file, without its line end.

    ``split`` and ``place`` order the records of a file.  A file that ends inside quotes has its last lines as one record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    lines = lines.withColumn("quotes", F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit(""))))
    here = Window.partitionBy("file", "split").orderBy("place")
    running = lines.withColumn("before", F.coalesce(F.sum("quotes").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = lines.groupBy("file", "split").agg(F.sum("quotes").alias("quotes")).withColumn("start", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    at = running.join(splits.select("file", "split", "start"), ["file", "split"])
    at = at.withColumn("begins", F.when((F.col("start") + F.col("before")) % 2 == 0, 1).otherwise(0))
    at = at.withColumns({"no": F.sum("begins").over(here.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("begins").over(here)})
    # Lines before the first record of a split belong to the last record of an earlier split.
    ends = at.groupBy("file", "split").agg(F.sum("begins").alias("n"))
    last = F.last(F.when(F.col("n") > 0, F.struct(F.col("split").alias("own_split"), F.col("n").alias("own_no"))), ignorenulls=True).over(earlier)
    ends = ends.withColumn("last", last).select("file", "split", "last")
    at = at.join(ends, ["file", "split"])
    alone = (F.col("begins") == 1) & (F.col("next") == 1)
    whole = at.where(alone).select("file", "split", F.col("no").alias("place"), F.col("line").alias("record"))
    own = [F.when(F.col("no") > 0, F.col("split")).otherwise(F.col("last.own_split")).alias("own_split"), F.when(F.col("no") > 0, F.col("no")).otherwise(F.col("last.own_no")).alias("own_no")]
    pieces = at.where(~F.coalesce(alone, F.lit(False))).select("file", *own, F.struct("split", "place", "line").alias("x"))
    joined = pieces.groupBy("file", "own_split", "own_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("record"))
    out = whole.unionByName(joined.select("file", F.col("own_split").alias("split"), F.col("own_no").alias("place"), "record"))
    return out.withColumn("record", F.regexp_replace("record", "\r$", ""))


def read_csv(spark: SparkSession, path: str, schema: ST.StructType, header: bool = True) -> DataFrame:
    """The rows of CSV files, with ``file``, ``split`` and ``place`` that order them; a record that doesn't fit the schema has null fields and is kept
    in ``_bad``, if the schema has that column.  Blank lines are no records."""
    rows = records(spark, path).where(F.col("record") != "")
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "maxCharsPerColumn": "-1"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = rows.select("file", "split", "place", F.from_csv("record", ddl, options).alias("x"))
    if header:  # the first record of a file
        first = rows.groupBy("file").agg(F.min(F.struct("split", "place")).alias("f"))
        parsed = parsed.join(F.broadcast(first), "file").where((F.col("split") != F.col("f.split")) | (F.col("place") != F.col("f.place"))).drop("f")
    return parsed.select("x.*", "file", "split", "place")
