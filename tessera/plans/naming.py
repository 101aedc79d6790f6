"""Queries about persons' names and the order of words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collation, persons


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bylines(docs):
    """A document's by-line: its first three words, and the first number of three digits or more in its text."""
    words = F.regexp_extract(F.coalesce("text", F.lit("")), r"^\s*(\p{L}+\s+\p{L}+\s+\p{L}+)", 1)
    number = F.regexp_extract(F.coalesce("text", F.lit("")), r"([0-9]{3,})", 1)
    return docs.select("doc_id", F.when(words != "", words).alias("name"), F.when(number != "", number).alias("number"))


def person_clusters(spark, sf_dir):
    """The persons of all by-lines."""
    return persons.clusters(bylines(_documents(spark, sf_dir)))


def name_pairs(spark, sf_dir):
    """By-lines of documents that follow one another in a source's ids: whether both rules take them for one person."""
    a = bylines(_documents(spark, sf_dir))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("name").alias("next_name"), F.col("number").alias("next_number"))
    full = lambda name, number: F.when(F.col(number).isNull(), F.col(name)).otherwise(F.concat_ws(" ", name, F.concat(F.lit("("), F.col(number), F.lit(")"))))
    left, right = full("name", "number"), full("next_name", "next_number")
    return a.join(b, "doc_id").select("doc_id", persons.same_person(left, right).alias("same"), persons.names_likely_same(left, right).alias("likely"))


NAME_PAIRS = r"""
WITH a AS (SELECT doc_id, nullif(regexp_extract(coalesce(text, ''), '^\s*(\p{L}+\s+\p{L}+\s+\p{L}+)', 1), '') AS name,
    nullif(regexp_extract(coalesce(text, ''), '([0-9]{3,})', 1), '') AS number FROM documents),
k AS (SELECT doc_id, number, lower(regexp_replace(coalesce(name, ''), '\s+', '', 'g')) AS key,
    list_distinct(list_filter(string_split_regex(lower(coalesce(name, '')), '\s+'), lambda x: length(x) >= 2)) AS words FROM a)
SELECT x.doc_id, coalesce(x.number = y.number, false) OR (x.key <> '' AND x.key = y.key) AS same,
  x.key = y.key OR len(list_intersect(x.words, y.words)) >= least(2, len(x.words), len(y.words)) AS likely
FROM k x JOIN k y ON y.doc_id = x.doc_id + 1
"""


def _words(docs):
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"([a-zA-Zäöüéèêáíóúñç]+)"), F.lit(1))).alias("word"))


def collated_words(spark, sf_dir):
    """Words of all documents that differ in case and accents only, as one."""
    return collation.spellings(_words(_documents(spark, sf_dir)), "word", "UNICODE_CI_AI")


COLLATED_WORDS = """
WITH w AS (SELECT unnest(regexp_extract_all(text, '[a-zA-Zäöüéèêáíóúñç]+')) AS word FROM documents)
SELECT min(word) AS word, count(DISTINCT word) AS n_spellings, count(*) AS n FROM w GROUP BY lower(strip_accents(word))
"""


def locale_order(spark, sf_dir):
    """The first two hundred words of all documents in German order."""
    return collation.first_in_order(_words(_documents(spark, sf_dir)), "word", "de", 200)


LOCALE_ORDER = """
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-zA-Zäöüéèêáíóúñç]+')) AS word FROM documents)
SELECT word, row_number() OVER (ORDER BY word COLLATE de, word) AS place FROM w QUALIFY place <= 200
"""

QUERIES = {
    "person_clusters": (person_clusters, None),
    "name_pairs": (name_pairs, NAME_PAIRS),
    "collated_words": (collated_words, COLLATED_WORDS),
    "locale_order": (locale_order, LOCALE_ORDER),
}
