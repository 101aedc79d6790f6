"""Order and equality of words under a language's collation, by Spark's collated strings.

Words are counted by their code points first, so the collated step sees each spelling once and moves little.  Defined cases: nulls are
no words; spellings that a collation takes for equal are shown by the smallest of them, by code points; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spellings(words: DataFrame, word: str, collation: str) -> DataFrame:
    """(word, n_spellings, n) of the words that are equal under ``collation``, a word standing for all."""
    plain = words.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("w")).agg(F.count("*").alias("n"))
    same = plain.groupBy(F.collate("w", collation).alias("__same"))
    return same.agg(F.min("w").alias("word"), F.count("*").alias("n_spellings"), F.sum("n").alias("n")).select("word", "n_spellings", "n")


def first_in_order(words: DataFrame, word: str, collation: str, top: int) -> DataFrame:
    """(word, place) of the ``top`` first distinct words in the order of ``collation``; words it takes for equal by code points."""
    first = words.where(F.col(word).isNotNull()).select(F.col(word).alias("word")).distinct().orderBy(F.collate("word", collation), "word").limit(top)
    listed = first.agg(F.array_sort(F.collect_list("word"), lambda a, b: F.when(F.collate(a, collation) < F.collate(b, collation), -1).when(F.collate(a, collation) > F.collate(b, collation), 1).when(a < b, -1).when(a > b, 1).otherwise(0)).alias("words"))
    return listed.select(F.posexplode("words").alias("place", "word")).select("word", (F.col("place") + 1).cast("long").alias("place"))
