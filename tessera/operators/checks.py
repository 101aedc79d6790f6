"""Checks of records against one another: fixity, two readings, change logs, runs, rankings and field rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def verified(manifest: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Each record of ``manifest`` (key, digest): verified, tampered or missing.  Only digests are joined, never the content."""
    now = found.select(key, F.col("digest").alias("found_digest"))
    status = F.when(F.col("found_digest").isNull(), "missing").when(F.col("found_digest") == F.col("digest"), "verified").otherwise("tampered")
    return manifest.join(now, key, "left").select(key, status.alias("status"))


def two_readings(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Values that two readers gave for a key (key, value): agree, disagree, or single where one is blank."""
    x, y = a.select(key, T.blank_to_null(F.col("value")).alias("x")), b.select(key, T.blank_to_null(F.col("value")).alias("y"))
    status = F.when(F.col("x").isNull() | F.col("y").isNull(), "single").when(T.normalized(F.col("x")) == T.normalized(F.col("y")), "agree").otherwise("disagree")
    return x.join(y, key, "full_outer").select(key, "x", "y", status.alias("status"))


def change_log(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """A row per field that a filled value of ``new`` changes: key, field, old and new value."""
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"o.{c}").alias("old_value"), T.blank_to_null(F.col(f"n.{c}")).alias("new_value")) for c in cols])
    rows = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}")).select(F.col(f"o.{key}").alias(key), F.explode(fields).alias("x"))
    return rows.select(key, "x.*").where(F.col("new_value").isNotNull() & ~F.col("new_value").eqNullSafe(F.col("old_value")))


def runs(df: DataFrame, key: str, ts: str, tie: str, value: str) -> DataFrame:
    """Islands of neighbouring rows with the same value: key, value, first and last time, rows."""
    order = Window.partitionBy(key).orderBy(ts, tie)
    is_new = F.when(F.lag(value).over(order).eqNullSafe(F.col(value)) & (F.row_number().over(order) > 1), 0).otherwise(1)
    marked = df.select(key, ts, tie, value, is_new.alias("is_new"))
    marked = marked.withColumn("run", F.sum("is_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "run", value).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n")).select(key, F.col("run").cast("long").alias("run"), value, "started", "ended", "n")


def ranking_is_valid(answer: Column, n_items: int) -> Column:
    """Whether a JSON answer ``[{id, score}]`` may be used: filled, ids known and unique, scores from 0 to 1; else it is rejected whole."""
    items = F.from_json(answer, "array<struct<id:int,score:double>>")
    ids = F.transform(items, lambda x: x["id"])
    good = F.forall(items, lambda x: F.coalesce(x["id"].between(1, n_items) & x["score"].between(0, 1), F.lit(False)))
    return F.coalesce((F.size(items) > 0) & good & (F.size(F.array_distinct(ids)) == F.size(ids)), F.lit(False))


def field_flags(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that a row breaks, comma-joined; a rule that is null isn't broken."""
    return F.array_join(F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules])), ",")


def first_rule(text: Column, rules: list[tuple[str, str]], otherwise: str = "none") -> Column:
    """The label of the first rule (phrase, label) whose phrase the text holds, in any case."""
    low, out = F.lower(text), F.lit(otherwise)
    for phrase, label in reversed(rules):
        out = F.when(F.contains(low, F.lit(phrase)), F.lit(label)).otherwise(out)
    return out


def fill_status(filled: Column, of: int) -> Column:
    """complete, partial, sparse or blank by how many of ``of`` fields are filled."""
    return F.when(filled >= of, "complete").when(filled * 2 >= of, "partial").when(filled > 0, "sparse").otherwise("blank")
