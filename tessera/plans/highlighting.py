"""Queries over marks in pages: the longer words of ``benchmark`` are keywords, a page's title is its sentence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import highlight


def page_highlights(spark, sf_dir):
    """The marks of every page, and whether removing them gives the page again."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html", F.array(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("sentences"))
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("w")).where(F.length("w") >= 7)
    keywords = [r["w"] for r in words.groupBy(F.lower("w").alias("w")).count().orderBy("w").limit(highlight.MOST + 1).collect()]  # more are refused
    out = highlight.highlighted(pages, "page_id", "html", keywords, "sentences")
    own = pages.select("page_id", F.md5("html").alias("own"))
    spans = F.array_join(F.transform("marks", lambda m: F.concat_ws(":", m["start"], m["end"], F.when(F.contains(m["classes"], F.lit("sentence")), "s").otherwise("k"))), ",")
    out = out.select("page_id", F.size("marks").alias("n_marks"), spans.alias("marks"), F.md5(highlight.without_marks(F.col("html"))).alias("again"))
    return out.join(own, "page_id").select("page_id", "n_marks", "marks", (F.col("again") == F.col("own")).alias("same"))


QUERIES = {"page_highlights": (page_highlights, None)}
