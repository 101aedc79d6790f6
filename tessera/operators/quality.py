"""Rule predicates on text: interstitials, boilerplate, risk and relevance scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of pages that block a reader.
BLOCKED = ("access denied", "enable javascript", "verify you are human", "captcha", "checking your browser", "subscribe to continue", "403 forbidden", "too many requests")


def looks_blocked(title: Column, text: Column, phrases: tuple[str, ...] = BLOCKED) -> Column:
    """Whether a blocking phrase stands in the title or the first 2000 characters."""
    head = F.lower(F.concat_ws(" ", title, F.substring(text, 1, 2000)))
    return reduce(lambda a, b: a | b, [F.contains(head, F.lit(p)) for p in phrases])


def boilerplate_features(rows: DataFrame, text: str, nav: str) -> DataFrame:
    """Adds n_tokens, distinct_ratio, n_sentences and nav_hits."""
    words = F.filter(F.split(F.lower(F.col(text)), "[^a-zà-ÿ]+"), lambda w: w != "")
    out = rows.withColumn("_w", words)
    out = out.withColumn("n_tokens", F.size("_w")).withColumn("distinct_ratio", F.when(F.size("_w") > 0, F.round(F.size(F.array_distinct("_w")) / F.size("_w"), 4)).otherwise(F.lit(0.0)))
    return out.withColumn("n_sentences", F.regexp_count(text, F.lit("[.!?]"))).withColumn("nav_hits", F.regexp_count(text, F.lit(nav))).drop("_w")


def looks_boilerplate(tokens: Column, ratio: Column, sentences: Column, nav: Column) -> Column:
    """Few sentences with many navigation marks, or the same words again and again."""
    return ((sentences < 3) & (nav >= 5)) | ((tokens >= 30) & (ratio < 0.35)) | (nav * 10 > tokens)


def rule_score(rules: list[tuple[str, Column, int]], cap: int = 100) -> tuple[Column, Column]:
    """Flags of the rules that hold, joined by commas, and their points, ``cap`` at most."""
    flags = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c, _ in rules])), ",")
    points = reduce(lambda a, b: a + b, [F.when(c, F.lit(p)).otherwise(F.lit(0)) for _, c, p in rules])
    return flags, F.least(points, F.lit(cap))


def level(score: Column, high: int = 60, medium: int = 30) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")
