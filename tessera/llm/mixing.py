"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources share ``total`` times all words by weight; a target stops at ``most`` times its source's words and the excess is
shared again by weight.  That fixed point is ``min(cap, level * weight)`` with one level for all, found from running sums over the
sources in the order of cap / weight.

Positions: each source has a weight schedule over training time 0..1 (here linear).  Its integral, scaled to the target, is the
source's cumulative demand for words; the document whose words start at ``c`` is trained at the time when the demand reaches ``c``.
Documents of a source follow one another in hashed order; once all its words are used it starts again.  Documents are range-sorted
by position.

A source may hold any share of the rows.  Running sums inside a source are in two levels: hashed order is cut into buckets, bucket
sums are added up per source, and only the rows of one (source, bucket) are summed in order.  The number of buckets grows with the
square root of the rows, so both levels stay small.

Defined cases: null texts have no words and are never taken; a null source is a source, last in order; equal ids or rows follow one
another in order of size; an empty table gives an empty result; a source without words has target 0; rows that differ in any column are
different documents, and rows equal in all are each taken; other columns, of any name, pass through ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import GAP, TMP, documents, n_words_of, text_of, written

#: By the place of a source in code-point order, repeating: weight, and schedule at the start and the end of training.
WEIGHTS = (3, 1, 2)
SCHEDULES = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))
TOTAL, MOST = 1.5, 2.0
ROW = (f"{TMP}row", f"{TMP}row2")


def _source_key(source: str) -> Column:
    """A key that is never null and keeps null apart from any text."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def targets(sources: DataFrame, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """``sources`` (skey, source, words), a row each, with place, weight and target."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    out = sources.withColumn("place", place).withColumn("weight", F.get(weights, F.col("place") % len(WEIGHTS))).withColumn("cap", most * F.col("words"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (total * F.sum("words").over(everything) - before) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    return out.withColumn("level", F.max(level).over(everything)).withColumn("target", F.least(F.col("cap"), F.col("level") * F.col("weight"))).drop("level", "cap")


def _time(share: Column, place: Column) -> Column:
    """When the demand reaches ``share`` of the target: the inverse of the schedule's integral."""
    a = F.get(F.array(*[F.lit(x) for x, _ in SCHEDULES]), place % len(SCHEDULES))
    b = F.get(F.array(*[F.lit(y) for _, y in SCHEDULES]), place % len(SCHEDULES))
    bent = (F.sqrt(F.greatest(a * a + (b - a) * (a + b) * share, F.lit(0.0))) - a) / F.when(a == b, F.lit(1.0)).otherwise(b - a)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(a == b, share).otherwise(bent)))


def _row_key(docs: DataFrame) -> list[Column]:
    """128 bits of hash over all columns of a row, nulls and their places included: equal for rows that are equal in all columns."""
    parts = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    gaps = [F.col(f"`{c}`").isNull() for c in docs.columns]
    return [F.xxhash64(F.lit(k), *gaps, *parts).alias(name) for k, name in enumerate(ROW)]


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row per row of ``docs``: row key, id, size, source_size, target, taken, and for each pass the words taken and the position.

    The row key (``ROW``) is a hash of all columns, with which ``mix`` finds the rows again.
    """
    sized = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            _source_key(source_col).alias("skey"),
            n_words_of(text_of(text_col)).alias("size"),
            F.xxhash64(F.lit("order"), F.col(id_col)).alias("at"),
            *_row_key(docs),
        ),
        "sizes",
    )
    bits = max(1, math.ceil(math.log2(max(2, sized.count())) / 2))
    sized = sized.withColumn("bucket", F.shiftrightunsigned("at", 64 - bits))
    sums = sized.groupBy("skey", "bucket").agg(F.sum("size").alias("words"), F.first("source", ignorenulls=True).alias("source"))
    goal = targets(sums.groupBy("skey").agg(F.sum("words").alias("words"), F.first("source", ignorenulls=True).alias("source")))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = sums.withColumn("offset", before).drop("words", "source").join(goal.select("skey", F.col("words").alias("source_size"), "target", "place"), "skey")
    inner = Window.partitionBy("skey", "bucket").orderBy("at", "doc_id", "size", *ROW).rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.join(cells, ["skey", "bucket"]).withColumn("cum", F.col("offset") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    whole = F.floor(F.col("target") + 1e-6)
    first = F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("cum"))).cast("long")
    second = F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("source_size") - F.col("cum"))).cast("long")
    rows = rows.withColumn("taken_1", first).withColumn("taken_2", second)
    return rows.select(
        *ROW,
        "doc_id",
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        (F.col("taken_1") + F.col("taken_2")).alias("taken"),
        "taken_1",
        "taken_2",
        F.when(F.col("taken_1") > 0, _time(F.col("cum") / F.col("target"), F.col("place"))).alias("position_1"),
        F.when(F.col("taken_2") > 0, _time((F.col("cum") + F.col("source_size")) / F.col("target"), F.col("place"))).alias("position_2"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The training order: a row for each time a document is taken, in order of position, with ``docs``' own columns.

    The last document that a source's target reaches is cut after the words still wanted; ``chars_col`` then follows the text.
    """
    own = docs.columns
    plan = placed(docs, id_col, text_col, source_col).where("taken > 0")
    times = plan.select(*ROW, "size", F.explode(F.array(*[F.struct(F.col(f"taken_{k}").alias("taken"), F.col(f"position_{k}").alias("position")) for k in (1, 2)])).alias("x"))
    times = times.where("x.taken > 0").select(*ROW, F.col("size").alias(f"{TMP}size"), F.col("x.taken").alias(f"{TMP}taken"), F.col("x.position").alias(f"{TMP}position"))
    # Of rows that are equal in all columns one stands for all and is joined to each of their places.
    rows = docs.select("*", *_row_key(docs)).dropDuplicates(list(ROW))
    out = rows.join(times, list(ROW))
    lead = F.when(F.col(text_col).rlike("^" + GAP), 1).otherwise(0)
    rest = F.element_at(F.split(F.col(text_col), GAP, (F.col(f"{TMP}taken") + 1 + lead).cast("int")), -1)
    cut = F.substring(F.col(text_col), F.lit(1), F.length(text_col) - F.length(rest))
    text = F.when(F.col(f"{TMP}taken") >= F.col(f"{TMP}size"), F.col(text_col)).otherwise(cut)
    out = out.orderBy(f"{TMP}position", *ROW).withColumn(text_col, text)
    if chars_col in own:
        out = out.withColumn(chars_col, F.length(text_col).cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in own])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: what the mix takes of every document, in training order."""
    rows = placed(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return rows.orderBy(F.col("position_1").asc_nulls_last(), "doc_id").select("doc_id", "size", "source_size", "target", "taken", "position_1", "position_2")
