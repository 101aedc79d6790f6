"""Sharding by histogram sort: shards of near equal bytes, in key order.

The key of a row is (hash of its text, id), so equal texts lie side by side and, unless a boundary falls among them, in one
shard.  Splitters are found by counting: each round puts candidate boundaries around every wanted byte offset, counts in one
aggregation the exact bytes, rows and key range between neighbouring boundaries, and narrows each splitter's interval, until it
is within ``tolerance`` of its offset or no other key lies between.  A text that holds a third of all rows is split by id like
any other range.  Only counts reach the driver: a few numbers for each boundary.

Each shard has as many cells as its bytes ask for (``CELL`` bytes each, ``CELLS`` in all at most, so that the driver's numbers stay
small), found as splitters in the same rounds.  Rows move once, to their cell; a row's slot is its rank in the cell plus the rows of the
shard's earlier cells, which the last count gave.

Defined cases: a null text counts as no bytes and hashes as empty; a null id sorts as 0; rows equal in text and id keep together;
an empty table gives an empty result; shards may be empty when there are fewer rows than shards; other columns pass through, but for
columns named ``shard`` and ``slot``, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TMP, documents, dropped, python_tasks, text_of, written

SHARDS = 24
#: Bytes of a cell, which is what one task sorts, and most cells of all shards.
CELL, CELLS = 64 << 20, 16_384
#: Share of a cell's bytes by which a splitter may miss its offset.
TOLERANCE = 0.01
#: Boundaries tried for each open splitter in a round.
PROBES = 5
LOW, HIGH = 0, (1 << 128) - 1
_HALF, _MASK = 1 << 63, (1 << 64) - 1


def _ordered(bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit boundaries as two signed halves."""
    return np.array([(b >> 64) - _HALF for b in bounds], dtype=np.int64), np.array([(b & _MASK) - _HALF for b in bounds], dtype=np.int64)


def _bin_of(bounds: list[int], k1: Column, k2: Column) -> Column:
    """Number of boundaries at or below the key."""
    first, second = _ordered(bounds)

    @F.pandas_udf("int")
    def bin_of(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.to_numpy(np.int64), b.to_numpy(np.int64)
        out = np.searchsorted(first, x, "left")
        ends = np.searchsorted(first, x, "right")
        tied = ends > out
        for v in np.unique(x[tied]):
            rows = x == v
            lo, hi = np.searchsorted(first, v, "left"), np.searchsorted(first, v, "right")
            out[rows] = lo + np.searchsorted(second[lo:hi], y[rows], "right")
        return pd.Series(out.astype(np.int32))

    return bin_of(k1, k2)


def _key(k1: int, k2: int) -> int:
    return ((k1 + _HALF) << 64) | (k2 + _HALF)


def _count(keys: DataFrame, bounds: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """For each bin that has rows: bytes, rows, least and greatest key.  Where the first halves differ, the second halves are open."""
    rows = keys.groupBy(_bin_of(bounds, F.col("k1"), F.col("k2")).alias("bin")).agg(
        F.sum("size").alias("b"), F.count("*").alias("n"), F.min("k1").alias("a0"), F.max("k1").alias("a1"), F.min("k2").alias("b0"), F.max("k2").alias("b1")
    )
    out = {}
    for r in rows.collect():  # as many rows as bins at most
        same = r["a0"] == r["a1"]
        out[r["bin"]] = (r["b"], r["n"], _key(r["a0"], r["b0"] if same else -_HALF), _key(r["a1"], r["b1"] if same else _HALF - 1))
    return out


def splitters(keys: DataFrame, parts: int, tolerance: float = TOLERANCE) -> tuple[list[int], list[int], int]:
    """``parts - 1`` boundaries (a part starts at its boundary), the rows of each part, and the rounds taken.

    ``keys``: k1, k2 and size.  The interval of each splitter shrinks every round to a bin between two probes, clipped to the keys
    in it, so a hot key is isolated after a few rounds and then split by its second half.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    goals = [total * j // parts for j in range(1, parts)]
    slack = max(1.0, tolerance * total / parts)
    # For each splitter: the interval, the bytes below its start and the bytes in it; None once settled.
    state: list[tuple[int, int, int, int] | None] = [(LOW, HIGH, 0, total)] * (parts - 1)
    found = [HIGH] * (parts - 1)
    rounds = 0
    while total and any(s is not None for s in state):
        rounds += 1
        probes: set[int] = set()
        for goal, s in zip(goals, state, strict=True):
            if s is None:
                continue
            lo, hi, below, inside = s
            width = hi - lo
            guess = lo + width * max(0, goal - below) // max(1, inside)
            probes |= {lo, hi + 1 if hi < HIGH else hi}
            probes |= {min(hi, max(lo + 1, lo + width * k // (PROBES + 1))) for k in range(1, PROBES + 1)}
            probes |= {min(hi, max(lo + 1, guess + d)) for d in (-width >> 8, -width >> 11, 0, width >> 11, width >> 8)}
        bounds = sorted(probes)
        bins = _count(keys, bounds)
        cum = [0]
        for k in range(len(bounds) + 1):
            cum.append(cum[-1] + (bins[k][0] if k in bins else 0))
        edges = np.array([cum[k + 1] for k in range(len(bounds))])  # bytes below each boundary
        for j, (goal, s) in enumerate(zip(goals, state, strict=True)):
            if s is None:
                continue
            k = int(np.searchsorted(edges, goal, "right"))  # the bin that holds the goal: bounds[k - 1] .. bounds[k]
            best = min((x for x in (k - 1, k) if 0 <= x < len(bounds)), key=lambda x: abs(int(edges[x]) - goal))
            here = bins.get(k)
            if abs(int(edges[best]) - goal) <= slack or here is None or here[2] == here[3]:
                if here is not None and abs(int(edges[best]) - goal) > slack:  # one key only: start at it or after it
                    found[j] = here[2] if goal - cum[k] <= here[0] / 2 else here[3] + 1
                else:
                    found[j] = bounds[best]
                state[j] = None
            else:
                state[j] = (here[2], here[3], cum[k], here[0])
    found = sorted(min(x, HIGH) for x in found)
    rows = _count(keys, found) if total else {}
    return found, [rows[k][1] if k in rows else 0 for k in range(parts)], rounds


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, near equal in the bytes of text (and 8 more a row)."""
    docs = docs.drop("shard", "slot")
    k1, k2 = F.xxhash64(text_of(text_col)), F.coalesce(F.col(id_col).cast("long"), F.lit(0))
    size = (F.octet_length(text_of(text_col)) + 8).cast("long")
    python_tasks(docs.sparkSession)
    keyed = docs.withColumn(f"{TMP}k1", k1).withColumn(f"{TMP}k2", k2)
    keys = written(keyed.select(F.col(f"{TMP}k1").alias("k1"), F.col(f"{TMP}k2").alias("k2"), size.alias("size")), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    cells = max(1, min(-(-total // (shards * CELL)), CELLS // shards))
    bounds, rows, _ = splitters(keys, shards * cells, tolerance)
    dropped(keys)
    starts = [sum(rows[c - c % cells : c]) for c in range(len(rows))]
    start = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")
    cell = F.col(f"{TMP}cell")
    rank = F.row_number().over(Window.partitionBy(cell).orderBy(f"{TMP}k1", f"{TMP}k2"))
    out = keyed.withColumn(f"{TMP}cell", _bin_of(bounds, F.col(f"{TMP}k1"), F.col(f"{TMP}k2")))
    out = out.withColumn("shard", F.floor(cell / cells).cast("int")).withColumn("slot", F.get(start, cell) + rank - 1)
    return out.drop(f"{TMP}k1", f"{TMP}k2", f"{TMP}cell")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: shard and slot of every document by the law ``bytes``."""
    digests = (F.octet_length(text_of()) + 8).cast("long").alias("size"), F.crc32(F.encode(text_of(), "UTF-8")).cast("long").alias("text_crc32")
    out = shard(documents(spark, sf_dir).select("doc_id", "text", *digests))  # the texts stay behind: only their digests move
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
