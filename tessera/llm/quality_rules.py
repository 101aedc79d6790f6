"""Quality rules: base rules on words and lines, then a hashed n-gram likelihood ratio.

Words and pairs of adjacent words are hashed into ``BUCKETS`` buckets.  Two multinomials over the buckets, one of the trusted texts and
one of the whole corpus, both smoothed by the same pseudo-counts, give each bucket a log ratio; the score of a text is the mean log
ratio of its n-grams, so texts of any length compare.  A text is kept if it passes the base rules and its score reaches ``THRESHOLD``.

Everything is DataFrame expressions.  The corpus is read once to count buckets (combined before the shuffle, so at most ``BUCKETS`` rows
leave a task) and once to score; scoring needs no shuffle.  A word's string is hashed once; pairs and 3-word windows combine the hashes.

The ids of the trusted texts are broadcast up to ``MOST`` of them (16 MB), which is counted first; beyond, the texts are joined to them
by a shuffle.  Both ways give the same counts.

Defined cases: a null text is empty; an empty text has no words, fails the base rules and is not kept; without trusted texts every score
is 0 and the base rules alone decide; ties at the threshold are kept; repeated rows are each judged; a null id is never trusted.  Other
columns pass through ``base``, ``score`` and ``keep``, but for columns that have the name of a result, which ``base`` and ``score``
replace.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TMP, documents, text_of, words_of

SYMBOLS = r"[#*$%&|<>]"
#: Size of both multinomials; the model is that many doubles, whatever the corpus.
BUCKETS = 1 << 16
#: Pseudo-counts of each bucket in the trusted multinomial; the corpus multinomial has as many for its size.  So many that a few copies
#: of a text that isn't among the trusted ones don't count against it.
PRIOR = 50.0
#: Mean log ratio from which a text is kept.
THRESHOLD = -0.03
LEAST_WORDS = 50
#: Most trusted ids that are broadcast.
MOST = 1 << 20


def _hashes(words: Column) -> Column:
    """A 64-bit hash of each word."""
    return F.transform(words, lambda x: F.xxhash64(x))


def _pair(h: Column, x: Column, i: Column) -> Column:
    """The hash of the word at ``i``, with hash ``x``, and the next one."""
    return F.xxhash64(x, F.get(h, i + 1))


def _bucket(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - (BUCKETS - 1).bit_length()).cast("int")


def grams(h: Column) -> Column:
    """Buckets of words and of pairs of adjacent words, from the words' hashes; the last word pairs with nothing."""
    pairs = F.transform(h, lambda x, i: _bucket(_pair(h, x, i)))
    return F.concat(F.transform(h, _bucket), F.slice(pairs, 1, F.greatest(F.size(h) - 1, F.lit(0))))


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR, most: int = MOST) -> list[float]:
    """The log ratio of each bucket: ``BUCKETS`` doubles.  ``trusted``: ids of the trusted texts, in its first column."""
    ids = trusted.select(F.col(trusted.columns[0]).alias(f"{TMP}id")).where(F.col(f"{TMP}id").isNotNull()).distinct()
    rows = docs.select(F.col(id_col).alias(f"{TMP}id"), F.col(text_col).alias(f"{TMP}text"))
    one = F.lit(1)
    if ids.count() <= most:
        rows = rows.join(F.broadcast(ids.withColumn(f"{TMP}good", one)), f"{TMP}id", "left")
    else:
        good = rows.join(ids, f"{TMP}id", "left_semi").withColumns({f"{TMP}all": F.lit(None).cast("int"), f"{TMP}good": one})
        rows = rows.withColumns({f"{TMP}all": one, f"{TMP}good": F.lit(None).cast("int")}).unionByName(good)
    hashed = rows.withColumn(f"{TMP}h", _hashes(words_of(text_of(f"{TMP}text"))))
    found = (
        hashed.select(F.col(f"{TMP}all") if f"{TMP}all" in rows.columns else one.alias(f"{TMP}all"), f"{TMP}good", F.explode_outer(grams(F.col(f"{TMP}h"))).alias("bucket"))
        .where(F.col("bucket").isNotNull())  # explode() would put a filter that splits the text again
        .groupBy("bucket")
        .agg(F.count(f"{TMP}all").alias("raw"), F.count(f"{TMP}good").alias("good"))
    )
    raw, good = [0.0] * BUCKETS, [0.0] * BUCKETS
    for row in found.collect():  # BUCKETS rows at most
        raw[row["bucket"]], good[row["bucket"]] = float(row["raw"]), float(row["good"])
    return log_ratios(raw, good, prior)


def log_ratios(raw: list[float], good: list[float], prior: float = PRIOR) -> list[float]:
    """Log of the trusted multinomial over the corpus', each with the same share of pseudo-counts; zeros without trusted n-grams."""
    n_raw, n_good = sum(raw), sum(good)
    share = n_good / n_raw if n_raw else 0.0
    return [math.log((g + prior) / (r * share + prior)) for r, g in zip(raw, good, strict=True)] if share else [0.0] * len(raw)


def _repeats(h: str) -> tuple[list[tuple[str, Column]], Column]:
    """Steps (name, expression) and the count of words inside a 3-word window that the text has twice or more.

    Windows are compared by 64-bit hashes.  Only texts with an equal pair sort their windows.
    """
    w, (hashes, ordered, places) = F.col(h), (f"{TMP}v", f"{TMP}s", f"{TMP}p")
    v, s, p = F.col(hashes), F.col(ordered), F.col(places)
    window = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    steps = [
        (hashes, F.when(F.size(w) > 3, F.slice(window, 1, F.greatest(F.size(w) - 2, F.lit(1))))),
        (ordered, F.when(F.size(F.array_distinct(v)) < F.size(v), F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))),
        (places, F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x["i"]))),
    ]
    count = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), x - F.coalesce(F.get(p, i - 1), x - 3))), F.lit(0), lambda a, x: a + x)
    return steps, F.coalesce(count, F.lit(0)).cast("long")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base(docs: DataFrame, text_col: str = "text", ratios: list[float] | None = None) -> DataFrame:
    """``docs`` with the counts of the base rules and ``base_failed``; with ``ratios`` also ``score``.

    The columns it adds hang on a value that the optimizer can't move, so a filter on them isn't computed below them again.
    """
    text, own = text_of(text_col), [c for c in docs.columns if c not in (*COUNTS, "base_failed", *(["score"] if ratios is not None else []))]
    w, h, lines = F.col(f"{TMP}w"), F.col(f"{TMP}h"), F.col(f"{TMP}l")
    out = docs.withColumn(f"{TMP}w", words_of(text))
    out = out.withColumns({f"{TMP}h": _hashes(w), f"{TMP}l": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    found = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }
    steps, found["n_repeat_words"] = _repeats(f"{TMP}h")
    if ratios is not None:
        found["score"] = _mean_ratio(h, ratios)
    for name, expr in steps:
        out = out.withColumn(name, expr)
    mark = f"{TMP}mark"
    out = out.select(*own, *[e.alias(f"{TMP}_{c}") for c, e in found.items()], F.monotonically_increasing_id().alias(mark))
    out = out.select(*own, *[F.when(F.col(mark) >= 0, F.col(f"{TMP}_{c}")).alias(c) for c in found])
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _mean_ratio(h: Column, ratios: list[float]) -> Column:
    """The mean log ratio of a text's n-grams, from its words' hashes; 0 without words."""
    model = F.split(F.lit(",".join(f"{x:.7g}" for x in ratios)), ",").cast("array<double>")  # folded once into a constant
    last = F.size(h) - 1
    each = F.transform(h, lambda x, i: F.get(model, _bucket(x)) + F.when(i < last, F.get(model, _bucket(_pair(h, x, i)))).otherwise(0.0))
    return F.when(last >= 0, F.round(F.aggregate(each, F.lit(0.0), lambda a, b: a + b) / (2 * last + 1), 9)).otherwise(F.lit(0.0))


def score(docs: DataFrame, ratios: list[float], text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the mean log ratio of its n-grams; 0 without any."""
    out = docs.withColumn(f"{TMP}h", _hashes(words_of(text_of(text_col))))
    return out.withColumn(name, _mean_ratio(F.col(f"{TMP}h"), ratios)).drop(f"{TMP}h")


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, counts, ``base_failed``, ``score`` and ``kept``."""
    ratios = fit(docs, trusted, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias(f"{TMP}text"))
    out = base(rows, f"{TMP}text", ratios)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).drop(f"{TMP}text")


def keep(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only."""
    ratios = fit(docs, trusted, id_col, text_col)
    own = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"{TMP}own{i}") for i, c in enumerate(own)])
    out = base(inner, f"{TMP}own{own.index(text_col)}", ratios)
    out = out.where(~F.col("base_failed") & (F.col("score") >= threshold))
    return out.select(*[F.col(f"{TMP}own{i}").alias(c) for i, c in enumerate(own)])


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that ``labels`` marks as good."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the counts, the base rules and the verdict for every document."""
    out = judge(documents(spark, sf_dir), trusted_ids(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
