"""Record linkage: tiered matches, hierarchy fallback, scored best match, upsert, comparison and consensus.

Reference lists are matched by equality wherever the rule allows it, so Spark hashes and shuffles both sides; a fuzzy rule first meets
on a blocking key.  No side is broadcast by hint; Spark's own size check decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def tiered(entities: DataFrame, tiers: list[tuple[DataFrame, str, str, int]], top: int = 5) -> DataFrame:
    """entities (entity): the ``top`` matches over tiers (table, key column, kind, confidence), by confidence, kind and key.

    Matching is equality of normalized names.  Entities without a match come with confidence 0.
    """
    wanted = entities.select("entity", T.normalized(F.col("entity")).alias("k")).distinct()
    parts = []
    for table, key, kind, conf in tiers:
        side = table.select(F.col(key).alias("matched"), T.normalized(F.col(key)).alias("k")).distinct()
        parts.append(wanted.join(side, "k").select("entity", F.lit(kind).alias("kind"), "matched", F.lit(conf).alias("confidence")))
    found = reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.col("confidence").desc(), "kind", "matched"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= top)
    return wanted.select("entity").join(best, "entity", "left").select("entity", "kind", "matched", F.coalesce("confidence", F.lit(0)).alias("confidence"), F.coalesce("rank", F.lit(1)).alias("rank"))


def ladder(rows: DataFrame, rungs: list[tuple[str, Column, Column]]) -> DataFrame:
    """``rows`` with the first rung (name, usable, value) that is usable, its value, and the names of the rungs skipped before it.

    Rungs are columns that joins to the parents have brought.
    """
    rung, value = F.lit("none"), F.lit(None).cast("string")
    for name, usable, v in reversed(rungs):
        rung, value = F.when(usable, F.lit(name)).otherwise(rung), F.when(usable, v).otherwise(value)
    skipped, before = [], F.lit(True)
    for name, usable, _ in rungs:
        before = before & ~usable
        skipped.append(F.when(before, F.lit(name)))
    return rows.withColumn("rung", rung).withColumn("resolved", value).withColumn("skipped", F.array_join(F.array_compact(F.array(*skipped)), ","))


def best_scored(candidates: DataFrame, key: str, row: str, rules: list[tuple[Column, float]], least: float) -> DataFrame:
    """The best candidate row of each key: the sum of the scores of the rules that hold, ``least`` at least; ties to the smaller row."""
    score = reduce(lambda a, b: a + b, [F.when(F.coalesce(c, F.lit(False)), F.lit(float(s))).otherwise(F.lit(0.0)) for c, s in rules])
    scored = candidates.withColumn("score", score).where(F.col("score") >= least)
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), row))
    return scored.withColumn("_r", best).where("_r = 1").drop("_r")


def upsert(target: DataFrame, updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``target`` with filled update values written over its own, new keys added, and ``action``: updated, kept or inserted.

    A blank update never overwrites.
    """
    a, b = target.alias("a"), updates.alias("b")
    value = lambda f: F.coalesce(T.blank_to_null(F.col(f"b.{f}")), F.col(f"a.{f}")).alias(f)
    changed = reduce(lambda x, y: x | y, [F.coalesce(T.blank_to_null(F.col(f"b.{f}")) != F.coalesce(F.col(f"a.{f}"), F.lit("")), F.lit(False)) for f in fields])
    action = F.when(F.col(f"a.{key}").isNull(), "inserted").when(changed, "updated").otherwise("kept")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[value(f) for f in fields], action.alias("action"))


def discrepancies(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row per key and field: both values and whether they differ; null where nothing can be compared."""
    long = lambda df, name: df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])).alias("x")).select(key, "x.*")
    both = long(left, "db_value").join(long(right, "live_value"), [key, "field"])
    a, b = T.blank_to_null(T.normalized(F.col("db_value"))), T.blank_to_null(T.normalized(F.col("live_value")))
    return both.withColumn("differs", F.when(a.isNotNull() & b.isNotNull(), a != b))


def consensus(a: DataFrame, b: DataFrame, keys: list[str], names: tuple[str, str] = ("a", "b"), bonus: float = 0.08, most: float = 0.98) -> DataFrame:
    """Answers of two providers (keys, confidence) as one list: what both say gains confidence."""
    x, y = a.withColumnRenamed("confidence", "ca"), b.withColumnRenamed("confidence", "cb")
    both = x.join(y, keys, "full_outer")
    agreed = F.least(F.lit(most), (F.col("ca") + F.col("cb")) / 2 + bonus)
    conf = F.when(F.col("ca").isNull(), F.col("cb")).when(F.col("cb").isNull(), F.col("ca")).otherwise(F.greatest("ca", agreed))
    sources = F.array_join(F.array_compact(F.array(F.when(F.col("ca").isNotNull(), names[0]), F.when(F.col("cb").isNotNull(), names[1]))), "+")
    return both.select(*keys, F.round(conf, 4).alias("confidence"), sources.alias("sources"))


def unique_match(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """``wanted`` (k) joined to ``rows`` by key where the key is unique among ``rows``."""
    single = rows.withColumn("k", key).where(F.col("k").isNotNull()).groupBy("k").agg(F.count("*").alias("n"), F.min(rows.columns[0]).alias("row"))
    return wanted.join(single, "k", "left").select("k", F.when(F.col("n") == 1, F.col("row")).alias("row"), F.coalesce("n", F.lit(0)).alias("n"))


def closest(names: DataFrame, choices: DataFrame, share: float = 0.1) -> DataFrame:
    """For each ``name`` the choice of least edit distance, if within ``share`` of its length (1 at least); ties to the smaller choice.

    An edit distance of at most d leaves one of d + 1 equal pieces of the choice unchanged, at most d places away; both sides emit
    those pieces as blocking keys, so only pairs that share a piece are compared.
    """
    n = names.select("name", F.lower("name").alias("a")).distinct().withColumn("d", T.edit_limit(F.col("a"), share))
    c = choices.select("choice", F.lower("choice").alias("b")).distinct()
    size, reach = F.length("b"), F.floor(F.length("b") * share * 2).cast("int") + 1
    # A choice is cut for every limit that a name within reach of its length may have.
    limits = F.array_distinct(F.transform(F.sequence(-reach, reach), lambda k: F.greatest(F.lit(1), F.floor((size + k) * share)).cast("int")))
    pieces = c.withColumn("d", F.explode(limits)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    step = F.floor(F.length("b") / (F.col("d") + 1)).cast("int")
    pieces = pieces.select("choice", "b", "d", "i", F.substring(F.col("b"), F.col("i") * step + 1, F.when(F.col("i") == F.col("d"), F.length("b")).otherwise(step)).alias("piece"), F.length("b").alias("lb"))
    probes = n.withColumn("lb", F.explode(F.sequence(F.greatest(F.lit(1), F.length("a") - F.col("d")), F.length("a") + F.col("d")))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d")))).withColumn("s", F.explode(F.sequence(-F.col("d"), F.col("d"))))
    width = F.floor(F.col("lb") / (F.col("d") + 1)).cast("int")
    at = F.col("i") * width + 1 + F.col("s")
    probes = probes.where(at >= 1).select("name", "a", "d", "i", "lb", F.substring(F.col("a"), at, F.when(F.col("i") == F.col("d"), F.col("lb") - F.col("i") * width).otherwise(width)).alias("piece"))
    pairs = probes.join(pieces, ["d", "i", "lb", "piece"]).select("name", "a", "d", "choice", "b").distinct()
    pairs = pairs.withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance") <= F.col("d"))
    best = F.row_number().over(Window.partitionBy("name").orderBy("distance", "choice"))
    return pairs.withColumn("_r", best).where("_r = 1").select("name", "choice", "distance")
