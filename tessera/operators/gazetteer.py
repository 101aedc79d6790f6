"""Joins of texts with a dictionary of names: counts, spans and bodies.

The dictionary is a reference list of bounded size (``MOST`` patterns); it is compiled once in each Python worker and texts stream past
it, so no pair of text and name is ever formed.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions import text as T

#: Most patterns of a dictionary that is sent with the tasks.
MOST = 100_000


#: Characters of words, in lower case.
LETTERS = "a-z0-9à-ÿ"


def counted(docs: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    """Occurrences of each term as whole words in each text that has it, in lower case."""
    low = F.lower(F.col(text_col))
    whole = lambda t: f"(?<![{LETTERS}])\\Q{t}\\E(?![{LETTERS}])"
    hits = F.array(*[F.struct(F.lit(t).alias("term"), F.when(F.contains(low, F.lit(t)), F.regexp_count(low, F.lit(whole(t)))).otherwise(0).cast("long").alias("n")) for t in terms])
    return docs.select(F.col(id_col), F.explode(hits).alias("x")).select(id_col, "x.*").where("n > 0")


def located(found: DataFrame) -> DataFrame:
    """Spans (id, start, term) as one row per text and term: mentions and first place, ranked by mentions, then by place."""
    out = found.groupBy("id", "term").agg(F.count("*").alias("mentions"), F.min("start").alias("first_at"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.col("mentions").desc(), "first_at")))


def first_phrases(text: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Of rules (phrase, office) in order: the offices whose phrase the text has as whole words, and the first of them.  A phrase is a pattern in lower
    case, which may have alternatives."""
    whole = lambda p: f"(?<![{LETTERS}])(?:{p})(?![{LETTERS}])"
    hits = T.let(F.lower(text), lambda low: F.array_compact(F.array(*[F.when(low.rlike(whole(p)), F.lit(o)) for p, o in rules])))
    return hits, F.get(hits, F.lit(0))


class NearNames:
    """Names of six letters or more, in lower case, by what stands before the anchor word they end with.

    A name that is ``k`` edits off at most has one of ``k + 1`` pieces of that part unchanged, at most ``k`` places from its own.  So a window of
    text is compared with the names that share a piece with it there, however many names there are.  Parts too short for pieces are
    compared always.
    """

    def __init__(self, names: list[str], anchors: tuple[str, ...], share: float = 0.15) -> None:
        self.names, self.anchors = names, anchors
        self.limits = [max(1, int(len(n) * share)) for n in names]
        self.always: dict[str, list[int]] = {a: [] for a in anchors}
        self.pieces: dict[str, dict[str, list[tuple[int, int]]]] = {a: {} for a in anchors}  # piece: names, and its end's distance from the anchor
        self.sizes: dict[str, set[int]] = {a: set() for a in anchors}
        for i, name in enumerate(names):
            for anchor in anchors if len(name) >= 6 else ():
                if not name.endswith(anchor):
                    continue
                part, n = name[: len(name) - len(anchor)], self.limits[i] + 1
                if len(part) < n:
                    self.always[anchor].append(i)
                    continue
                for j in range(n):
                    start, end = len(part) * j // n, len(part) * (j + 1) // n
                    self.pieces[anchor].setdefault(part[start:end], []).append((i, len(part) - end))
                    self.sizes[anchor].add(end - start)
        self.reach = {a: max((len(n) - len(a) + k for n, k in zip(names, self.limits, strict=True) if n.endswith(a)), default=0) for a in anchors}

    def candidates(self, text: str, at: int, anchor: str) -> set[int]:
        """Names that the text before the anchor at ``at`` may be a few edits off."""
        found, pieces = set(self.always[anchor]), self.pieces[anchor]
        for size in self.sizes[anchor]:
            for end in range(at, max(size, at - self.reach[anchor]) - 1, -1):
                found.update(i for i, gap in pieces.get(text[end - size : end], ()) if abs(at - end - gap) <= self.limits[i])
        return found

    def find(self, text: str, taken: tuple[tuple[int, int], ...] = ()) -> list[tuple[int, int, str, int]]:
        """(start, end, name, distance) of windows of ``text`` that end at an anchor word and are a few edits off a name that ends so.

        A name of ``n`` letters may be ``share`` of them off, one at least and not none; windows over ``taken`` spans are left out; the
        shortest window that fits counts.
        """
        found, spans = [], _merged(taken)
        starts = [a for a, _ in spans]
        for anchor in self.anchors:
            at = text.find(anchor)
            while at >= 0:
                end = at + len(anchor)
                before = bisect_left(starts, end)
                free = spans[before - 1][1] if before else 0  # windows that start before it lie over a taken span
                for i in sorted(self.candidates(text, at, anchor)):
                    name, limit = self.names[i], self.limits[i]
                    for n in range(len(name) - limit, len(name) + limit + 1):
                        if free <= end - n and 0 < (d := _edits(text[end - n : end], name, limit)) <= limit:
                            found.append((end - n, end, name, d))
                            break
                at = text.find(anchor, at + 1)
        return sorted(found)


def near_names(text: str, names: list[str], anchors: tuple[str, ...], share: float = 0.15, taken: tuple[tuple[int, int], ...] = ()) -> list[tuple[int, int, str, int]]:
    return NearNames(names, anchors, share).find(text, taken)


def _merged(spans: tuple[tuple[int, int], ...]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _edits(a: str, b: str, limit: int) -> int:
    """Edit distance, or ``limit + 1`` if it is more."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > limit:
            return limit + 1
    return min(row[-1], limit + 1)


def fuzzy(docs: DataFrame, id_col: str, text_col: str, names: list[str], anchors: tuple[str, ...], share: float = 0.15) -> DataFrame:
    """Names that texts have with a few edits, near anchor words: id, start, end, term, distance.  Exact mentions are left out."""
    if len(names) > MOST:
        raise ValueError(f"a dictionary has {MOST} patterns at most")
    low = sorted({n.lower() for n in names if n})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        near, machine = NearNames(low, anchors, share), ahocorasick.Automaton()
        for name in low:
            machine.add_word(name, len(name))
        machine.make_automaton()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = (text or "").lower()
                if low and any(a in t for a in anchors):
                    rows += [(key, *x) for x in near.find(t, tuple((end + 1 - n, end + 1) for end, n in machine.iter(t)))]
            cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32()), strict=True)], ["id", "start", "end", "term", "distance"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, start int, end int, term string, distance int")


def leftmost_longest(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of overlapping spans (start, end, what) the one that starts first, then the longest."""
    out, at = [], 0
    for start, end, what in sorted(found, key=lambda x: (x[0], -x[1])):
        if start >= at:
            out.append((start, end, what))
            at = end
    return out


def spans(docs: DataFrame, id_col: str, text_col: str, terms: list[str], suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Leftmost-longest spans (start, end in code points of the lower-case text, term).

    A name must begin at a word start and end at a word end or before one of ``suffixes``.
    """
    if len(terms) > MOST:
        raise ValueError(f"a dictionary has {MOST} patterns at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            machine.add_word(term.lower(), (i, len(term)))
        machine.make_automaton()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, found = (text or "").lower(), []
                for end, (i, n) in machine.iter(low):
                    start, stop = end - n + 1, end + 1
                    rest = low[stop : stop + 12]
                    if (start == 0 or not low[start - 1].isalnum()) and (not rest[:1].isalnum() or any(rest.startswith(s) for s in suffixes)):
                        found.append((start, stop, i))
                rows += [(key, a, b, terms[i]) for a, b, i in leftmost_longest(found)]
            cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], ["id", "start", "end", "term"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, start int, end int, term string")


def bodies(found: DataFrame, method_rank: dict[str, int]) -> DataFrame:
    """Spans (id, start, term, body, method) as one row per text and body: strongest method, mentions, first place, surfaces."""
    rank = F.coalesce(F.get(F.array(*[F.lit(None).cast("int")]), F.lit(0)), F.lit(0))
    for name, r in method_rank.items():
        rank = F.when(F.col("method") == name, r).otherwise(rank)
    out = found.groupBy("id", "body").agg(F.max_by("method", rank).alias("method"), F.count("*").alias("mentions"), F.min("start").alias("first_at"), F.array_sort(F.collect_set("term")).alias("surfaces"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.col("mentions").desc(), "first_at")))
