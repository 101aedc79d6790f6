"""From raw documents to token ids in training order.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and returns a DataFrame, and all but the last keep the columns of
``documents``.  ``run`` applies them one after another and writes each result to the shared folder, so that a stage is computed once
and a lost executor costs its tasks only.

Defined cases, stage by stage.  Nulls: a null text fails the quality rules; a row without an id is never a near duplicate and stays; a
null source is a source of its own; null columns else pass through.  Empty texts and texts without words fail the quality rules; where
a stage is given them all the same, they have no near duplicates, no secrets, no words to mix and no tokens.  Very long texts are read
whole in every stage.  Ties: the smallest id of a group of near duplicates stays; a score at the threshold is kept.  Repeated rows are
judged alike: near dedup keeps all rows of the id that stays, the mix takes each.  Empty tables give empty tables in every stage.  Extra
columns, of any name, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, near_duplicates, quality_rules, secrets
from tessera.llm.common import documents, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return quality_rules.keep(docs, quality_rules.trusted_ids(spark, sf_dir))


#: Jaccard similarity of five-word sets, in per cent, from which the pipeline takes documents for near duplicates.
NEAR = 80


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id."""
    return near_duplicates.keep(docs, near=NEAR)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; no document goes."""
    return secrets.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in training order."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids instead of texts: little-endian unsigned 32-bit integers in one binary value."""
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", bpe.n_tokens(F.col("ids")).alias("n_tokens"), "ids")


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("secret_scan", mask_secrets), ("mix_sources", mix_sources), ("bpe_encode", encode)]

#: The likelihood ratio, the signatures and the encoding can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
