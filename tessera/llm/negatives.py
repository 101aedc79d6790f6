"""Hard-negative mining: for anchors, their nearest rows of the same label, and rows of other labels that are nearly as near.

Components become integers, so scores (inner products) are exact and ties are real.  All rows are scored against all anchors, a
stated part of the rows, in blocks:

1. Positives.  Rows of a label are dealt to blocks of about ``ROWS``, anchors of the label to blocks of ``ANCHORS``; a task gets one
   block of each and returns each anchor's highest scores.  A window merges the blocks' results.
2. Negatives.  Blocks of all rows meet blocks of anchors with their positives.  A task sorts each anchor's scores of the rows of other
   labels by score and id, finds each positive's upper limit by binary search, and reads from there on, down to the lower limit.  The first
   of all rows are among the first of each block, so merging the blocks' first ones by a window is exact.

Blocks have bounded numbers of rows whatever a label's share is, and more of them than tasks.  Scores come from a matrix product in
doubles where all partial sums are below 2**53, else from one in 64-bit integers.

Defined cases: rows with a null id, label or vector, or a null, NaN or infinite component take no part; components that a shorter
vector lacks count as 0; repeated rows and ids each take part, as anchors too, but a row with the anchor's id is neither its positive nor
its negative; ties go to the smaller id; a negative score of a positive has no negatives, as the limits exclude each other; an anchor
without positives gives nothing; empty tables give empty results; other columns, of any name, don't take part.  Scores must fit in
a signed 64-bit integer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, python_tasks, written
from .near_duplicates import _spread

#: Positives of an anchor, negatives of a positive, and per cent of the positive's score from which a row is a hard negative.
POSITIVES, NEGATIVES, LEAST = 5, 5, 80
#: Rows and anchors of a block at most, nearly, and scores that are held at once.
ROWS, ANCHORS, SCORES = 1 << 17, 1 << 13, 1 << 22
SCALE = 256


def whole(vector: Column, scale: int = SCALE) -> Column:
    """The components as integers; null if one isn't a number."""
    inf = float("inf")
    known = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x != inf) & (x != -inf))
    return F.when(known, F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("long")))


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of integers as rows of a matrix, filled up with zeros."""
    lists = vectors.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
    offsets = lists.offsets.to_numpy()
    lengths = np.diff(offsets)
    flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = flat
    return out


def _width(*tables: pa.Table) -> int:
    import pyarrow.compute as pc

    return max((pc.max(pc.list_value_length(t["vec"])).as_py() or 0 for t in tables), default=0)


def _scores(anchors: np.ndarray, rows: np.ndarray):
    """Blocks (first anchor, scores) of the exact inner products."""
    most = lambda x: int(np.abs(x).max(initial=0))
    exact = most(anchors) * most(rows) * max(1, rows.shape[1]) < 1 << 53
    a, r = (anchors.astype(np.float64), rows.astype(np.float64)) if exact else (anchors, rows)
    step = max(1, SCORES // max(1, len(rows)))
    for at in range(0, len(a), step):
        yield at, (a[at : at + step] @ r.T).astype(np.int64)


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """Ids, labels and the table in order of the ids."""
    table = table.sort_by("vec_id")
    return table["vec_id"].to_numpy(), table["label"].to_numpy(), table


def _first_positives(k: int):
    def run(key, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(anchors) and len(rows):
            ids, _, rows = _sorted(rows)
            width = _width(anchors, rows)
            own, marks = anchors["vec_id"].to_numpy(), anchors["row"].to_numpy()
            for at, scores in _scores(_matrix(anchors["vec"], width), _matrix(rows["vec"], width)):
                for i, s in enumerate(scores, at):
                    others = np.flatnonzero(ids != own[i])
                    best = others[np.argsort(-s[others], kind="stable")[:k]]
                    out[0].append(np.full(len(best), marks[i])), out[1].append(ids[best]), out[2].append(s[best])
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in out], ["anchor", "positive_id", "positive_score"])

    return run


def limited(scores: np.ndarray, positive: int, k: int, least: int = LEAST) -> tuple[int, int]:
    """Of descending scores, where the first ``k`` begin and end that are at most the positive's score and ``least`` per cent of it at least."""
    begin = int(np.searchsorted(-scores, -positive, side="left"))
    end = int(np.searchsorted(-scores, least * positive // -100, side="right"))  # -ceil(least * positive / 100)
    return begin, max(begin, min(end, begin + k))


def _first_negatives(k: int, least: int):
    def run(key, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if len(anchors) and len(rows):
            ids, labels, rows = _sorted(rows)
            width = _width(anchors, rows)
            own, marks, mine = anchors["vec_id"].to_numpy(), anchors["row"].to_numpy(), anchors["label"].to_numpy()
            wanted = anchors["scores"].to_pylist()
            for at, scores in _scores(_matrix(anchors["vec"], width), _matrix(rows["vec"], width)):
                for i, s in enumerate(scores, at):
                    others = np.flatnonzero((labels != mine[i]) & (ids != own[i]))
                    order = others[np.argsort(-s[others], kind="stable")]  # by score, then by id, as the rows lie by id
                    down = s[order]
                    for p in wanted[i]:
                        begin, end = limited(down, p, k, least)
                        found = order[begin:end]
                        out[0].append(np.full(len(found), marks[i])), out[1].append(np.full(len(found), p)), out[2].append(ids[found]), out[3].append(s[found])
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in out], ["anchor", "positive_score", "negative_id", "negative_score"])

    return run


def _dealt(df: DataFrame, by: str, mine: str, others: str) -> DataFrame:
    """``df`` with block numbers: its own of ``mine`` blocks, in column ``by``, and a copy for each of ``others`` blocks of the other side."""
    other = {"r": "a", "a": "r"}[by]
    df = df.select(*[F.col(c).alias(c) for c in df.columns])  # columns of its own, as both sides come from one table
    return df.withColumn(by, F.pmod(F.xxhash64("row"), F.col(mine))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1))).drop(mine, others)


def _best(df: DataFrame, of: list[str], score: str, key: str, k: int) -> DataFrame:
    """The first ``k`` rows of each group, by descending score and ascending key, numbered in ``rank``."""
    order = Window.partitionBy(*of).orderBy(F.col(score).desc(), F.col(key))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, rows: int = ROWS, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label (of any comparable type, as long) and vec (array of long, from ``whole``); ``is_anchor`` is a condition on them.
    """
    spark = vectors.sparkSession
    python_tasks(spark)
    known = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull())
    known = known.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vec", is_anchor.alias("is_anchor"))
    held = written(known.withColumn("row", F.monotonically_increasing_id()), "vectors")
    # Blocks are full, or as many as keep all tasks busy.
    size = held.agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("a")).first()
    block = max(1, min(rows, -(-size["n"] // (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    blocks = lambda n, most: F.greatest(F.lit(1), F.ceil(n / most)).cast("long")
    columns = ("row", "vec_id", "label", "vec")

    per = held.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("n_a")).where("n_a > 0")
    per = per.select("label", blocks(F.col("n"), block).alias("r_blocks"), blocks(F.col("n_a"), anchors).alias("a_blocks"))
    at = _spread(held, per, "label", "row").where("r_blocks IS NOT NULL")
    left = _dealt(at.where("is_anchor").select(*columns, "r_blocks", "a_blocks"), "a", "a_blocks", "r_blocks")
    right = _dealt(at.select(*columns, "r_blocks", "a_blocks"), "r", "r_blocks", "a_blocks")
    near = left.groupBy("label", "a", "r").cogroup(right.groupBy("label", "a", "r")).applyInArrow(_first_positives(positives), "anchor long, positive_id long, positive_score long")
    near = written(_best(near, ["anchor"], "positive_score", "positive_id", positives).drop("rank"), "positives")

    wanted = near.groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))
    asked = held.where("is_anchor").join(wanted, F.col("row") == F.col("anchor")).select(*columns, "scores")
    n_blocks = [blocks(F.lit(n), most).alias(name) for n, most, name in ((size["n"], block, "r_blocks"), (size["a"], anchors, "a_blocks"))]
    left = _dealt(asked.select("*", *n_blocks), "a", "a_blocks", "r_blocks")
    right = _dealt(held.select(*columns, *n_blocks), "r", "r_blocks", "a_blocks")
    hard = left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInArrow(_first_negatives(negatives, least), "anchor long, positive_score long, negative_id long, negative_score long")
    hard = written(_best(hard, ["anchor", "positive_score"], "negative_score", "negative_id", negatives), "negatives")

    named = near.join(held.where("is_anchor").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    out = named.join(hard, ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    out = written(out, "mined")
    dropped(held, near, hard)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: hard negatives of the rows whose id is divisible by 100, where every seventh row has the next label."""
    key, label = F.col("vec_id"), F.col("label")
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = table.select("vec_id", F.when(key % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), whole(F.col("embedding")).alias("vec"))
    return mine(vectors, key % 100 == 0)


ORACLE = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""
