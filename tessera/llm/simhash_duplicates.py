"""SimHash near-dedup by a Hamming join under the generalised pigeonhole principle.

A text's terms are its three-word shingles (A-Z in lower case, words joined by one space, repeats included), or its whole word sequence if
it has fewer words.  A bit of the 64-bit fingerprint is 1 if more than half of the terms' XXH64 digests have it.  Documents link if
their fingerprints differ in ``RADIUS`` bits at most, and components of linked documents are reported by their smallest id.

1. Equal fingerprints are one point, a row from here on, so copies cost one row each.
2. Bits that go together are put into one partition: a greedy grouping by the correlations of all points' bits, counted in the tasks.
3. If partition i is searched within t_i differing bits, and the ``t_i + 1`` add up to ``RADIUS + 1``, a pair within the radius is found
   in some partition, whatever the t_i are (-1: not searched).  So every point gets thresholds of its own: dynamic programming over
   the partitions deals out ``RADIUS + 1`` units at the least estimated number of probes and candidates.  The estimate takes slices of
   at most ``SLICE`` bits of a partition as independent; how many points have each value of a slice is counted over all points.  Numbers of partitions
   are compared by the same estimate over all points, since more partitions make fewer probes and longer candidate lists.
4. Points are entered under their value in every partition, and probe all values within their thresholds.  Probes meet entries by a join;
   pairs are verified on whole fingerprints as its condition.
5. A value that more than ``GROUP`` rows meet at isn't paired.  Its points are linked through midpoints: two points differ in two bits
   at most if and only if some value differs from both in one bit at most.  Each point is listed under its 65 such values; those listed under one
   value are at most 65, are all linked, and are linked to the least of them.  So dense groups cost 65 rows a point, not pairs.

Only the bits' counts, the slices' counts and the costs reach the driver, a few thousand numbers whatever the corpus.

Defined cases: a null or empty text, or one without words, has the fingerprint zero and links like any other; a null id has its
component's least id, or null if no row of it has an id; repeated ids and rows are each returned, each by its own text; texts of any length are
read whole; an empty table gives an empty result; other columns, of any name, don't take part, and pass through ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TMP, documents, dropped, python_tasks, written
from .near_duplicates import _counted, _spread, components

BITS, SHINGLE, SEED, RADIUS = 64, 3, 42, 2
#: Numbers of partitions that are compared, and most bits of a slice.
PARTITIONS, SLICE = (2, 3, 4), 8
#: Rows that meet at a value in pairs; more meet by midpoints.
GROUP = 64
#: Digests whose bits are counted at once.
VOTES = 1 << 14
_ONE = np.uint64(1)


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned integer."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and the six separators
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    terms = zip(begins[: len(words) - k].tolist(), ends[k:].tolist(), strict=True)
    h = np.fromiter((digest(line[a:b], SEED) for a, b in terms), np.uint64, len(words) - k)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(h), VOTES):
        votes += _bits(h[at : at + VOTES]).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * votes > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])


def _bits(points: np.ndarray) -> np.ndarray:
    """A row of ``BITS`` zeros and ones for each, the lowest bit first."""
    return np.unpackbits(points.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text) and point, the fingerprint as a signed integer."""
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.array([fingerprint(x) for x in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(points.view(np.int64))], ["doc_id", "mark", "point"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, point long")


def _totals(points: DataFrame, add, size: int) -> np.ndarray:
    """The sum of ``add(points)``, an array of ``size`` counts, over all batches: ``size`` rows at most leave a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.float64)
        for batch in batches:
            total += add(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["i", "n"])

    out = np.zeros(size)
    for row in points.select("point").mapInArrow(run, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[row["i"]] = row["n"]
    return out


def _together(points: np.ndarray) -> np.ndarray:
    """For each two bits, how many points have both."""
    x = _bits(points).astype(np.float32)
    return (x.T @ x).astype(np.float64).ravel()


def grouped(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """``m`` partitions of the bits, nearly equal in size, each begun with the two bits that go together most and extended by the bit
    that goes best with those it has; ties take the lowest bits."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(share * (1 - share))
    with np.errstate(divide="ignore", invalid="ignore"):
        tied = np.abs(np.nan_to_num((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread), posinf=0, neginf=0))
    np.fill_diagonal(tied, 0)
    free, out = set(range(BITS)), []
    for i in range(m):
        size = (BITS - sum(map(len, out))) // (m - i)
        mine = list(min(combinations(sorted(free), 2), key=lambda p: (-tied[p], p))) if size > 1 else [min(free)]
        while len(mine) < size:
            mine.append(min(free - {*mine}, key=lambda b: (-tied[b, mine].sum(), b)))
        free -= {*mine}
        out.append(mine)
    return out


class Partitioning:
    """Partitions of the bits, their slices, and what the search of a point costs."""

    def __init__(self, parts: list[list[int]]):
        self.parts = parts
        self.slices = [[p[k * len(p) // s : (k + 1) * len(p) // s] for k in range(s)] for p in parts for s in [-(-len(p) // SLICE)]]
        self.n_slices = sum(map(len, self.slices))
        self.size = self.n_slices << SLICE

    @staticmethod
    def values(points: np.ndarray, bits: list[int]) -> np.ndarray:
        out = np.zeros(len(points), np.uint64)
        for k, b in enumerate(bits):
            out |= ((points >> np.uint64(b)) & _ONE) << np.uint64(k)
        return out

    def count(self, points: np.ndarray) -> np.ndarray:
        """How many of the points have each value of each slice."""
        out = [np.bincount(self.values(points, s).astype(np.int64), minlength=1 << SLICE) for p in self.slices for s in p]
        return np.concatenate(out).astype(np.float64)

    def learn(self, counts: np.ndarray, n: int) -> None:
        """From the counts: the share of the points at each distance, up to the radius, from each value of a slice."""
        values = np.arange(1 << SLICE)
        apart = np.bitwise_count(values[:, None] ^ values[None, :])
        near = np.stack([(apart == d).astype(np.float64) for d in range(RADIUS + 1)])
        shares = counts.reshape(self.n_slices, 1 << SLICE) / max(n, 1)
        self.near, self.n = np.einsum("dvu,su->svd", near, shares), n

    def costs(self, points: np.ndarray) -> np.ndarray:
        """For each point and partition, the estimated probes and candidates with 0 to ``RADIUS + 1`` units."""
        out, at = np.zeros((len(points), len(self.parts), RADIUS + 2)), 0
        for i, (part, slices) in enumerate(zip(self.parts, self.slices, strict=True)):
            share = np.zeros((len(points), RADIUS + 1))
            share[:, 0] = 1
            for s in slices:
                near = self.near[at][self.values(points, s).astype(np.int64)]
                share = np.stack([sum(share[:, a] * near[:, d - a] for a in range(d + 1)) for d in range(RADIUS + 1)], axis=1)
                at += 1
            probes = np.cumsum([1, len(part), len(part) * (len(part) - 1) // 2])
            out[:, i, 1:] = probes[: RADIUS + 1] + self.n * np.cumsum(share, axis=1)
        return out

    def allocate(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of each point in each partition, ``RADIUS + 1`` in all, at the least cost; and that cost."""
        costs = self.costs(points)
        n, m, _ = costs.shape
        best = np.full((n, RADIUS + 2), np.inf)
        best[:, 0] = 0
        picks = np.zeros((m, n, RADIUS + 2), np.int64)
        for i in range(m):
            options = np.full((RADIUS + 2, n, RADIUS + 2), np.inf)  # by units given to this partition
            for u in range(RADIUS + 2):
                options[u, :, u:] = best[:, : RADIUS + 2 - u] + costs[:, i, u : u + 1]
            picks[i], best = options.argmin(axis=0), options.min(axis=0)
        units, left, rows = np.zeros((n, m), np.int64), np.full(n, RADIUS + 1), np.arange(n)
        for i in reversed(range(m)):
            units[:, i] = picks[i][rows, left]
            left = left - units[:, i]
        return units, best[:, RADIUS + 1]

    def rows(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """key, point, whether it is entered and whether it probes there: keys are a partition's number and a value."""
        units, _ = self.allocate(points)
        found: list[tuple] = []
        for i, part in enumerate(self.parts):
            own = self.values(points, part)
            found.append((own | np.uint64(i << 32), points, np.ones(len(points), bool), units[:, i] > 0))
            flips = [sum(1 << b for b in c) for d in range(1, RADIUS + 1) for c in combinations(range(len(part)), d)]
            for u in range(2, RADIUS + 2):
                mine = units[:, i] == u
                masks = np.array([f for f in flips if f.bit_count() < u], np.uint64)
                keys = (own[mine][:, None] ^ masks[None, :]).ravel() | np.uint64(i << 32)
                found.append((keys, np.repeat(points[mine], len(masks)), np.zeros(len(keys), bool), np.ones(len(keys), bool)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def partitioning(points: DataFrame, n: int, choices: tuple[int, ...] = PARTITIONS) -> Partitioning:
    """The partitioning, of ``choices`` partitions, whose estimated cost over all points is least."""
    both = _totals(points, _together, BITS * BITS).reshape(BITS, BITS)
    plans = [Partitioning(grouped(both, n, m)) for m in choices]
    counts = _totals(points, lambda x: np.concatenate([p.count(x) for p in plans]), sum(p.size for p in plans))
    at = 0
    for p in plans:
        p.learn(counts[at : at + p.size], n)
        at += p.size
    costs = _totals(points, lambda x: np.array([p.allocate(x)[1].sum() for p in plans]), len(plans))
    return plans[int(costs.argmin())]


def _met(points: DataFrame, plan: Partitioning) -> DataFrame:
    """key, point, entered, probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, point, entered, probes = plan.rows(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(point.view(np.int64)), pa.array(entered), pa.array(probes)], ["key", "point", "entered", "probes"])

    return points.select("point").mapInArrow(run, "key long, point long, entered boolean, probes boolean")


def through_midpoints(points: DataFrame) -> DataFrame:
    """Links (a, b) that connect all points within two bits of each other: each value's points are linked to the least of them."""
    masks = [0, *(1 << b if b < 63 else -(1 << 63) for b in range(BITS))]
    at = points.select("point", F.explode(F.transform(F.array(*[F.lit(x).cast("long") for x in masks]), lambda x: F.col("point").bitwiseXOR(x))).alias("middle"))
    members = at.groupBy("middle").agg(F.min("point").alias("a"), F.collect_list("point").alias("x")).where(F.size("x") > 1)  # 65 at most
    return members.select("a", F.explode("x").alias("b")).where("a <> b")


def links(points: DataFrame, n: int, group: int = GROUP, choices: tuple[int, ...] = PARTITIONS) -> DataFrame:
    """Links (a, b) between distinct points, whose components are those of all pairs within the radius."""
    met = written(_met(points, partitioning(points, n, choices)), "met")
    shared = written(met.groupBy("key").agg(F.count("*").alias("n"), F.max("entered").alias("some")).where("n > 1 AND some").select("key", "n"), "shared")
    kept = written(_spread(met, shared, "key", "point").where(F.col("n").isNotNull()), "kept")
    dropped(met, shared)
    few = kept.where(F.col("n") <= group)
    one, two = (few.where(flag).select(F.col("key").alias(f"{x}_key"), F.col("point").alias(x)) for flag, x in (("probes", "a"), ("entered", "b")))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    paired = one.join(two, (F.col("a_key") == F.col("b_key")) & (F.col("a") != F.col("b")) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crowd = kept.where(F.col("n") > group).select("point").distinct()
    out = written(paired.unionByName(through_midpoints(crowd)).distinct(), "links")
    dropped(kept)
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, choices: tuple[int, ...] = PARTITIONS) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, point) for all of ``docs``, and (point, component) for all points."""
    rows = written(signed(docs, id_col, text_col), "fingerprints")
    points, n = _counted(rows.groupBy("point").agg(F.min("doc_id").alias("id")), "points")
    found = links(points, n, group, choices)
    comps = components(found)
    dropped(found)
    least = comps.join(points, F.col("node") == F.col("point")).groupBy("comp").agg(F.min("id").alias("component"))
    known = _spread(comps, least, "comp").select(F.col("node").alias("point"), "component")
    return rows, points.join(known, "point", "left").select("point", F.coalesce("component", "id").alias("component"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: fingerprint and component of every document."""
    rows, found = classes(documents(spark, sf_dir))
    return rows.join(found, "point", "left").select("doc_id", F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with their own columns only; rows without an id stay."""
    rows, found = classes(docs, id_col, text_col)
    verdict = rows.join(found, "point").where(F.col("doc_id") == F.col("component")).select(F.col("doc_id").alias(f"{TMP}id"), F.col("mark").alias(f"{TMP}mark")).distinct()
    kept = docs.join(verdict, (F.col(id_col).cast("long") == F.col(f"{TMP}id")) & (F.xxhash64(text_col) == F.col(f"{TMP}mark")), "left_semi")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
