"""Importance resampling of documents towards a target distribution.

Features are runs of 1 to ``RUNS`` consecutive words, hashed into ``BUCKETS`` buckets.  Each bucket has a gain, the log ratio of the
target's and the corpus' smoothed multinomials in thousandths; a document's weight is the sum of the gains of its features, repeats
counted, looked up in one array.  Gumbel noise that hangs on the document's id and ``SEED`` alone is added to the weight, so that the
highest scores are a draw without replacement in proportion to the exponentials of the weights, and reruns agree.

1. Texts are read once: each document becomes its features' buckets, two bytes each, in a written table.  Counts are added up in the
   tasks, so at most ``BUCKETS`` rows leave one, and the gains are an array of ``BUCKETS`` integers, whatever the corpus.
2. Scores are integers.  Their histogram is a table, a row each score that occurs.  ``BINS`` ranges of scores are added up from the top on
   the driver; within a range a window adds up its scores.  So every score knows how many documents are above it, and scores that
   have fewer above them than are to be drawn survive; the least of them is the cutoff.
3. Only documents of surviving scores are sorted, by id within their score; rank = documents above the score + place in it.  The noise of
   a document has any one value with a chance of 1 in 2,700 at most, so no score gathers a larger share of the documents, copies
   included.

Defined cases: a null or empty text, or one without words, has no features and the weight 0, and is never drawn; a document without an id
counts for the gains, but has no score and is neither drawn nor counted as one that could be; repeated rows and ids each take part, and
rank one after another, by features and weight where score and id are equal; texts of any length are read whole; an empty corpus gives an
empty result, an empty target gives every document gains from the corpus alone; other columns, of any name, don't take part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, dropped, python_tasks, written

#: Most words of a feature, buckets, per cent of the documents that are drawn, words that a drawn document has at least, seed of the noise.
RUNS, BUCKETS, SHARE, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024
#: Ranges of scores whose counts the driver adds up.
BINS = 4096
#: Features whose bucket a task remembers; it forgets all when there are more.
KNOWN = 1 << 18
#: A-Z become a-z, other ASCII characters but digits and a-z become blanks; bytes of other characters stay.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class _Buckets(dict):
    """Buckets by feature."""

    def __missing__(self, feature: bytes) -> int:
        self[feature] = out = zlib.crc32(feature) % BUCKETS
        return out


def features(text: str | None, runs: int = RUNS) -> list[bytes]:
    words = (text or "").encode("utf-8", "replace").translate(_FOLDED).split()
    return words + [b" ".join(words[i : i + k]) for k in range(2, runs + 1) for i in range(len(words) - k + 1)]


def bucketed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS) -> DataFrame:
    """doc_id, n_words, n_features and ``buckets``, the features' buckets as unsigned 16-bit integers in one binary value."""
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets()
        for batch in batches:
            n_words, packed = [], []
            for text in batch.column(1).to_pylist():
                found = features(text, runs)
                packed.append(np.fromiter(map(known.__getitem__, found), "<u2", len(found)).tobytes())
                n_words.append(len(found) if runs == 1 else len(features(text, 1)))
                if len(known) > KNOWN:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array([len(x) // 2 for x in packed], pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def counts(rows: DataFrame) -> np.ndarray:
    """How many features of ``rows`` (from ``bucketed``) each bucket has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for row in rows.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio in thousandths, rounded down; every bucket has one feature more in both."""
    n_corpus, n_target = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * n_corpus / ((s + 1.0) * n_target))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise in thousandths, rounded down, from the first 32 bits of a digest of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def scored(rows: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``rows`` (from ``bucketed``) with weight and score instead of their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(gain[np.frombuffer(x.as_buffer(), "<u2")].sum()) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    out = rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _above(hist: DataFrame, lo: int, hi: int, drawn: int) -> DataFrame:
    """score and ``above``, the documents with a higher one, of the scores that have less than ``drawn`` above them."""
    spark, width = hist.sparkSession, (hi - lo) // BINS + 1
    binned = hist.withColumn("bin", F.expr(f"(score - {lo}L) div {width}L"))
    total, starts = 0, []
    for row in sorted(binned.groupBy("bin").agg(F.sum("c").alias("c")).collect(), reverse=True):  # BINS rows at most
        if total < drawn:
            starts.append((row["bin"], total))
        total += row["c"]
    higher = Window.partitionBy("bin").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = binned.join(F.broadcast(spark.createDataFrame(starts, "bin long, start long")), "bin")
    out = out.select("score", (F.col("start") + F.coalesce(F.sum("c").over(higher), F.lit(0))).alias("above"))
    return out.where(F.col("above") < drawn)


def ranked(rows: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` (from ``scored``, written) with ``rank``: from 1 for the highest of the ``share`` per cent that are drawn, null for the rest."""
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    hist = written(rows.where(able).groupBy("score").agg(F.count("*").alias("c")), "histogram")
    ends = hist.agg(F.sum("c").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    drawn = (ends["n"] or 0) * share // 100
    none = F.lit(None).cast("long")
    if not drawn:
        return rows.withColumn("rank", none)
    places = written(_above(hist, ends["lo"], ends["hi"], drawn), "places")
    dropped(hist)
    cutoff = places.agg(F.min("score")).first()[0]
    survives = F.coalesce(able & (F.col("score") >= cutoff), F.lit(False))
    within = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features", "weight"))
    top = rows.where(survives).join(places, "score").withColumn("rank", F.col("above") + within).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return top.select(*rows.columns, "rank").unionByName(rows.where(~survives).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, runs: int = RUNS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``; ``target`` has the texts to come near to."""
    rows = written(bucketed(docs, id_col, text_col, runs), "features")
    wanted = bucketed(target.withColumn("__t_none", F.lit(None).cast("long")), "__t_none", target_col, runs)
    out = written(scored(rows, gains(counts(rows), counts(wanted)), seed), "scores")
    dropped(rows)
    return ranked(out, share, least_words)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: weight, score and rank of every document, drawn towards the texts of ``benchmark``."""
    out = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: Distinct words get their checksum by the definition of CRC-32, byte by byte, from a table made by its polynomial.
ORACLE = r"""
WITH RECURSIVE
texts AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
rows AS (SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) r(i))),
words AS (SELECT DISTINCT unnest(words) AS word FROM rows),
coded AS (SELECT word, hex(encode(word)) AS x FROM words),
buckets AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS b FROM coded, crc),
used AS (SELECT side, doc_id, b, count(*) AS n FROM (SELECT side, doc_id, unnest(words) AS word FROM rows) JOIN buckets USING (word) GROUP BY ALL),
tally AS (SELECT r.b, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM range(10000) r(b) LEFT JOIN used USING (b) GROUP BY r.b),
gain AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM tally),
weights AS (SELECT doc_id, sum(n * g)::BIGINT AS weight FROM used JOIN gain USING (b) WHERE side = 'd' GROUP BY doc_id),
scores AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT AS h FROM rows LEFT JOIN weights USING (doc_id) WHERE side = 'd'),
final AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scores),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM final WHERE n_features >= 20)
SELECT f.doc_id, f.n_features, f.weight, f.score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM final f LEFT JOIN drawn USING (doc_id)
"""
