"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every text becomes one row of statistics (lengths, character classes, lines, repetition), never its id, language, source or label.
The statistics of a bounded sample of labelled documents (``SAMPLE`` at most, those with the least hash of their id) are cut into
quantile bins, and trees are grown level by level from gradient and curvature histograms.  The trees are flattened into arrays
(feature, threshold, value; a node's children stand at 2i+1 and 2i+2), which travel to the tasks, where numpy walks all rows of a
batch down each tree at once.  Scoring is a pure function of a row; nothing is shuffled but the labels' join.

Defined cases: a null text is empty, and empty texts are scored by their (zero) statistics; without labelled rows of both classes
every score is the share of good labels, or 0.5; repeated rows are scored alike; equal statistics give equal scores; of several texts
of a labelled id the one with the greatest statistics is learned from; a null id is neither held out nor learned from; an empty table
gives an empty result; other columns, of any name, don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, python_tasks

#: Most labelled rows that are learned from.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST = 60, 4, 64, 0.15, 1.0, 5.0
CUT = 0.3
FEATURES = (
    "n_chars", "n_words", "mean_word", "long_words", "distinct_words", "lower", "upper", "digit", "space", "high_bytes", "punctuation",
    "stops", "commas", "bangs", "pipes", "symbols", "n_lines", "mean_line", "repeated_lines", "repeated_chars", "capital_words", "marked_words",
)


def statistics(text: str) -> list[float]:
    """The document's statistics, in the order of ``FEATURES``."""
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, words, lines = max(1, len(raw)), raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    k, m = max(1, len(words)), max(1, len(lines))
    total = lambda chars: float(counts[np.frombuffer(chars, np.uint8)].sum())
    distinct = set(words)
    lengths = np.fromiter(map(len, words), np.int32, len(words))
    repeated = len(lines) - len(set(lines))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), float(lengths.sum()) / k, float((lengths > 12).sum()) / k, len(distinct) / k,
        float(counts[97:123].sum()) / n, float(counts[65:91].sum()) / n, float(counts[48:58].sum()) / n, total(b" \t\n\r") / n, float(counts[128:].sum()) / n,
        total(b".,;:!?'\"()-") / n, total(b".") / k, total(b",") / k, total(b"!") / k, total(b"|") / k, total(b"#*$%&<>@^~_=+") / k,
        np.log1p(len(lines)), len(words) / m, repeated / m, 1.0 - len(b"".join(set(lines))) / n, sum(w.isupper() for w in distinct) / max(1, len(distinct)), sum(not w[-1:].isalnum() for w in distinct) / max(1, len(distinct)),
    ]


def _stats_column(text: Column) -> Column:
    @F.arrow_udf("array<float>")
    def stats(texts: pa.Array) -> pa.Array:
        rows = np.array([statistics(t or "") for t in texts.to_pylist()], np.float32).reshape(-1, len(FEATURES))
        return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES), rows.ravel())

    return stats(text)


class Trees:
    """A start value and complete trees of one depth as arrays."""

    def __init__(self, start: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.start, self.feature, self.threshold, self.value = start, feature, threshold, value

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Rows are all walked down one tree, one level at a time."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (2**DEPTH - 1)]
        return 1.0 / (1.0 + np.exp(-out))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosts trees on log loss.  A node without a gainful split sends its rows left."""
    mean = float(y.mean()) if len(y) else 0.5
    mean = min(max(mean, 1e-3), 1 - 1e-3)
    start, inner, leaves, d = float(np.log(mean / (1 - mean))), 2**DEPTH - 1, 2**DEPTH, x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        return Trees(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # bin b: above cut b - 1, up to cut b
    flat = binned + np.arange(d) * BINS
    raw, features, thresholds, values = np.full(len(y), start), [], [], []
    for _ in range(TREES):
        p = 1.0 / (1.0 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node, feature, threshold = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (d * BINS) + flat).ravel()
            hist = [np.bincount(at, np.repeat(w, d), width * d * BINS).reshape(width, d, BINS) for w in (g, h)]
            gl, hl = (np.cumsum(z, 2) for z in hist)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
            gain[(hl < LEAST) | (ht - hl < LEAST)] = 0
            for j, c in enumerate(cuts):
                gain[:, j, len(c) :] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9:
                    feature[first + k], threshold[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        raw += value[leaf]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return Trees(start, np.array(features), np.array(thresholds), np.array(values))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Learns ``quality`` from at most ``sample`` labelled rows of doc_id, text that aren't held out; a document labelled twice
    counts once, with the greater label."""
    python_tasks(docs.sparkSession)
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", _stats_column(F.col("text")).alias("x"), "quality")
    rows = rows.groupBy("doc_id").agg(F.max(F.struct("x", "quality")).alias("r")).orderBy("doc_id").select("r.x", "r.quality").collect()
    x = np.array([r["x"] for r in rows], np.float32).reshape(-1, len(FEATURES))
    return grow(x, np.array([float(r["quality"]) for r in rows]))


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    python_tasks(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch.column(2).to_pylist()], np.float32).reshape(-1, len(FEATURES))
            p = trees.probability(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the score of every document."""
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
