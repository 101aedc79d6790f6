"""Resolution of detected names to directory rows: match, climb to a parent with officers, merge requests that end at one card.

A directory has the columns ministry, division, office, has_officers and row (its order).  A level row repeats its name: a ministry's
row has it in all three columns, a division's in division and office.  Every step is an equality join on normalized names, so Spark
shuffles both sides by key; nothing is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_ROW = ("ministry", "division", "office", "has_officers", "row")


def _first(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The first row, by ``row``, of each key, as columns of one struct ``r``; blank keys have none."""
    keyed = rows.select(*[T.blank_to_null(T.normalized(c)).alias(k) for k, c in keys.items()], F.struct(F.col("row"), *[c for c in _ROW if c != "row"]).alias("r"))
    return keyed.dropna(subset=list(keys)).groupBy(*keys).agg(F.min("r").alias("r"))


def matched(entities: DataFrame, directory: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """entities (entity, pos) with ``r``, the directory row whose office it names, or that an alias (alias, ministry, division, office)
    stands for, or null.

    Level rows have their name as office, so an equal office finds offices, ministries and divisions alike; ties take the first row.
    """
    out = entities.withColumn("k", T.blank_to_null(T.normalized(F.col("entity")))).join(_first(directory, {"k": F.col("office")}), "k", "left")
    if aliases is None:
        return out.drop("k")
    triple = {"m": F.col("ministry"), "d": F.col("division"), "o": F.col("office")}
    known = aliases.select(T.normalized(F.col("alias")).alias("k"), *[T.normalized(c).alias(n) for n, c in triple.items()]).dropDuplicates(["k"])
    by_alias = known.join(_first(directory, triple), list(triple)).select("k", F.col("r").alias("by_alias"))
    return out.join(by_alias, "k", "left").select("entity", "pos", F.coalesce("r", "by_alias").alias("r"))


def climbed(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """``rows`` (r) with the rung at which officers are found, the row there (``resolved``) and the rungs skipped before it.

    Rungs: the office itself, the row of its division within the ministry, the ministry's row; then ``none``.
    """
    name = lambda c: T.normalized(F.col(c))
    division = _first(directory, {"m": F.col("ministry"), "d": F.col("office")}).withColumnRenamed("r", "div")
    ministry = _first(directory.where((name("ministry") == name("division")) & (name("ministry") == name("office"))), {"m": F.col("ministry")}).withColumnRenamed("r", "min")
    m, d, o = (T.normalized(F.col(f"r.{c}")) for c in ("ministry", "division", "office"))
    out = rows.withColumns({"m": m, "d": F.when(d != m, d), "own_d": d, "own_o": o}).join(division, ["m", "d"], "left").join(ministry, "m", "left")
    same = lambda x: F.col(f"{x}.row").eqNullSafe(F.col("r.row"))
    has = lambda x: F.coalesce(F.col(f"{x}.has_officers"), F.lit(False))
    up, top = F.col("div").isNotNull() & ~same("div"), F.col("min").isNotNull() & ~same("min")
    rung = F.when(has("r"), "office").when(up & has("div"), "division").when(top & has("min"), "ministry").otherwise("none")
    resolved = F.when(has("r"), F.col("r")).when(up & has("div"), F.col("div")).when(top & has("min"), F.col("min"))
    reasons = [
        F.when(~has("r"), "office:no_officers"),
        F.when(~has("r") & up & ~has("div"), "division:no_officers").when(~has("r") & ~up & (F.col("own_d") != F.col("m")) & (F.col("own_d") != F.col("own_o")), "division:no_row"),
        F.when(~has("r") & ~(up & has("div")) & top & ~has("min"), "ministry:no_officers").when(~has("r") & ~(up & has("div")) & F.col("min").isNull(), "ministry:no_row"),
    ]
    return out.withColumns({"rung": rung, "resolved": resolved, "skipped": F.array_join(F.array_compact(F.array(*reasons)), ",")}).drop("m", "d", "own_d", "own_o", "div", "min")


def _key(row: str) -> Column:
    return F.concat_ws("|", *[F.trim(F.col(f"{row}.{c}")) for c in ("ministry", "division", "office")])


def cards(entities: DataFrame, directory: DataFrame, aliases: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """A card for each row that entities (entity, pos) end at: card key, rung, first position, entities that asked for it, the first of
    them, the row it matched and what was skipped; in order of first position, ``most`` at most.

    Names without a row get no card.  Combines before its shuffle, so a card that many names ask for is one row a task.
    """
    found = climbed(matched(entities, directory, aliases).where(F.col("r").isNotNull()), directory)
    found = found.withColumn("card", F.coalesce(F.when(F.col("resolved").isNotNull(), _key("resolved")), F.concat(F.lit("none:"), _key("r"))))
    first = lambda c: F.min_by(c, "pos")
    out = found.withColumn("asked", _key("r")).groupBy("card").agg(
        F.min("pos").alias("pos"), first("rung").alias("rung"), F.count_distinct(F.trim("entity")).alias("n_entities"), first("entity").alias("first_entity"), first("asked").alias("matched"), first("skipped").alias("skipped")
    )
    return out if most is None else out.orderBy("pos").limit(most)


def classified(entities: DataFrame, classes: DataFrame, directory: DataFrame) -> DataFrame:
    """Cards of entities (entity, pos) that no row names, by an injected classification (entity, ministry, office, confidence): the
    ministry's row, or what the named office within it climbs to; rows without officers give none."""
    rest = matched(entities, directory).where(F.col("r").isNull()).select("entity", "pos").join(classes, "entity")
    name = lambda c: T.normalized(F.col(c))
    level = directory.where((name("ministry") == name("division")) & (name("ministry") == name("office")))
    top = _first(level, {"m": F.col("ministry")}).withColumnRenamed("r", "top")
    office = _first(directory, {"m": F.col("ministry"), "o": F.col("office")})
    rows = rest.withColumns({"m": name("ministry"), "o": T.blank_to_null(name("office"))}).join(top, "m").join(office, ["m", "o"], "left").select("entity", "pos", "confidence", "top", "r")
    end = F.coalesce(F.col("resolved"), F.col("top"))
    return climbed(rows, directory).withColumn("end", end).where(F.col("end.has_officers")).select("entity", "pos", _key("end").alias("card"), F.lit("classified").alias("rung"), "confidence")


def verified_names(names: DataFrame, directory: DataFrame, shown: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` distinct names (name, pos) that are ministries of the directory by exact normalized name, and not shown yet."""
    known = directory.select(T.normalized(F.col("ministry")).alias("k")).distinct()
    seen = shown.select(T.normalized(F.col("name")).alias("k")).distinct()
    out = names.withColumn("k", T.normalized(F.col("name"))).join(known, "k", "left_semi").join(seen, "k", "left_anti")
    return out.groupBy("k").agg(F.min_by("name", "pos").alias("name"), F.min("pos").alias("pos")).orderBy("pos").limit(most).select("name", "pos")
