"""Merging of records from several sources: dedupe, precedence, placeholders, replacement by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Precedence of source kinds, first wins.
PRECEDENCE = ("human_confirmed", "live", "subpage", "file", "human_saved", "infocom", "archive", "crosscheck")


def merged(rows: DataFrame, identity: str, order: str, fields: list[str]) -> DataFrame:
    """One row per identity with the first filled value of each field; rows without identity are dropped.

    Combines before the shuffle, so an identity with many rows sends one row a task.
    """
    filled = lambda f: F.min_by(f, F.when(T.blank_to_null(F.col(f)).isNotNull(), F.col(order))).alias(f)
    return rows.where(T.blank_to_null(F.col(identity)).isNotNull()).groupBy(identity).agg(*[filled(f) for f in fields], F.count("*").alias("merged"))


def by_precedence(rows: DataFrame) -> DataFrame:
    """rows (row_key, field, value, source_kind, seq): the filled value of the best source, and whether sources disagree."""
    rank = reduce(lambda acc, k: F.when(F.col("source_kind") == k[1], k[0]).otherwise(acc), enumerate(PRECEDENCE), F.lit(len(PRECEDENCE)))
    filled = rows.where(T.blank_to_null(F.col("value")).isNotNull()).withColumn("_at", F.struct(rank.alias("rank"), F.col("seq")))
    key = T.normalized(F.col("value"))
    return filled.groupBy("row_key", "field").agg(
        F.min_by("value", "_at").alias("value"), F.min_by("source_kind", "_at").alias("source_kind"), (F.min(key) != F.max(key)).alias("conflict")
    )


def placeholders(rows: DataFrame, value: str, name: str, least: int = 3) -> DataFrame:
    """Values that ``least`` rows or more share under more than one name."""
    out = rows.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("uses"), F.countDistinct(name).alias("names"))
    return out.where((F.col("uses") >= least) & (F.col("names") > 1))


def same_signature(rows: DataFrame, fields: list[str], key: str, least: int = 2) -> DataFrame:
    return rows.groupBy(*fields).agg(F.count("*").alias("rows"), F.min(key).alias("first_row")).where(F.col("rows") >= least)


def occurrences(rows: DataFrame, kinds: dict[str, str], source: str) -> DataFrame:
    """Counts of each name by kind over several columns, and of their distinct sources."""
    long = rows.select(F.col(source).alias("s"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in kinds.items()])).alias("x"))
    return long.select("s", "x.*").groupBy("kind", "name").agg(F.count("*").alias("n"), F.countDistinct("s").alias("sources"))


def distinct_first_seen(lists: list[DataFrame], bits: int = 12) -> DataFrame:
    """The names of several lists (name, position) without repeats by case, in the order first seen.

    Places are counted within cells of ``2**bits`` positions of a list; only the cells' counts are added up in one task.
    """
    tagged = [df.toDF("name", "pos").withColumns({"list": F.lit(i), "pos": F.col("pos").cast("long")}) for i, df in enumerate(lists)]
    at = F.struct("list", "pos")
    firsts = reduce(DataFrame.unionByName, tagged).groupBy(F.lower("name").alias("k")).agg(F.min_by("name", at).alias("name"), F.min(at).alias("at"))
    cells = firsts.select("name", "at.list", "at.pos", F.shiftright("at.pos", bits).alias("cell"))
    before = F.sum("n").over(Window.orderBy("list", "cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cells.groupBy("list", "cell").agg(F.count("*").alias("n")).select("list", "cell", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("list", "cell").orderBy("pos", "name"))
    return cells.withColumn("rank", rank).join(offsets, ["list", "cell"]).select("name", (F.col("before") + F.col("rank")).cast("int").alias("place"))


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new``, and the rows of ``old`` whose keys aren't in it."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def coverage(rows: DataFrame, tier: str, found: dict[str, Column]) -> DataFrame:
    """Rows of each tier and the per cent of them for which each condition holds."""
    return rows.groupBy(tier).agg(F.count("*").alias("n"), *[F.round(100.0 * F.count_if(c) / F.count("*"), 1).alias(f"{k}_pct") for k, c in found.items()])
