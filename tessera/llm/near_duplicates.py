"""MinHash near-dedup by a multi-index Hamming join.

A text's set is its distinct five-word shingles (A-Z in lower case), or its whole word sequence if it has fewer words.  Documents
are linked if their sets' Jaccard similarity reaches ``NEAR`` per cent, and components of linked documents keep their smallest id.

1. Each set gets a signature of ``CHUNKS * PLACES`` MinHash values of 16 bits and a digest.  Documents with equal digests have equal
   sets and are one class, a row with a number (``node``) from here on, so copies cost one row each.
2. Signatures are cut into ``CHUNKS`` chunks.  Two signatures that differ in at most ``CHUNKS * (ERRORS + 1) - 1`` places differ, by
   pigeonhole, in at most ``ERRORS`` places of some chunk.  Every way to choose those places is enumerated: the key is the chunk, the
   choice and the values of its other places.  All pairs under that distance share a key.  (A pair at the Jaccard threshold has more
   than ``ERRORS`` errors in every chunk with a chance of 5e-6 at 85 %, and of 1e-4 at 80 %, the pipeline's threshold.)
3. Keys of one class alone are dropped.  Classes that are left get their sets.  A class of whose shingles less than the threshold's
   share (85 %) is found in other such classes can't reach the threshold with any of them and is dropped; that bound is exact.
4. Keys become links in rounds, and every link is confirmed on the full sets.  Two star rounds link each member of a key to one of its
   members (the least; then, of those not linked so, a random one), a row per member, whatever the size of the group.  The last round
   takes the pairs of a key that are still in different components and that exact bounds allow: sizes, shared shingles, and the Hamming
   distance of parity sketches, which the symmetric difference can't be less than.
5. Keys that still hold over ``GROUP`` classes in several components don't make all their pairs: two sets that are similar enough share
   one of the rarest shingles of each (as many as either may lack, and one more), so their classes meet on those instead, in a star
   round and then in pairs.  That too is exact.  No key, group or candidate is capped.

Components are found by hooking every node onto its smallest neighbour and drawing the links between what remains.  Joins on a
component are salted, as one component may hold a third of all classes.

Only counts reach the driver.  Tables between the steps are written to the shared folder, and deleted once they are used up.

Defined cases: a null or empty text, or one without words, has an empty set (0 shingles), links with nothing and is its own
component; a null id has the component of the documents with its set, or none if none of them has an id; repeated ids and rows are each
returned, each by its own text; ties take the smallest id; an empty table gives an empty result; other columns, of any name, don't take
part, and pass through ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import TMP, documents, dropped, python_tasks, written

NEAR = 85
SHINGLE = 5
CHUNKS, PLACES, ERRORS = 4, 6, 2
VALUES = CHUNKS * PLACES
#: Longs of a set's parity sketch.
SKETCH = 8
#: Classes of a key that are paired with one another in the last round; larger groups meet on their rarest shingles.
GROUP = 32
#: Tasks that share the rows of one component.
SALTS = 16
#: How often hooks are followed in a turn, each time twice as far.
JUMPS = 2
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_WEIGHTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


_SEEDS = _mixed(np.arange(1, VALUES + 1, dtype=np.uint64) * _WEIGHTS[0]) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and the six separators
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b"\x00".join(words), 1)], np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total = _mixed(total + h[k : k + n] * _WEIGHTS[k])
    return np.unique(total)


def signature(items: np.ndarray) -> np.ndarray:
    """The MinHash values, 16 bits of each."""
    out = np.empty(VALUES, np.int64)
    for i in range(VALUES):
        x = items * _SEEDS[i]
        least = items[int((x ^ (x >> np.uint64(29))).argmin())]
        out[i] = int(_mixed(np.array([least ^ _SEEDS[i]], np.uint64))[0] & np.uint64(0xFFFF))
    return out


def digest(items: np.ndarray) -> str | None:
    """Equal for equal sets; null for the empty one."""
    return f"{len(items)}:{int(items.sum(dtype=np.uint64)):x}:{int(_mixed(items).sum(dtype=np.uint64)):x}" if len(items) else None


_PACKED = [f"s{i}" for i in range(VALUES // 4)]


def packed(sign: np.ndarray) -> list[int]:
    """Four values in each signed 64-bit integer, the first one lowest."""
    return sign.astype("<u2").view("<i8").tolist()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, signs = [], [], []
        for text in batch.column(1).to_pylist():
            items = shingles(text)
            counts.append(len(items))
            digests.append(digest(items))
            signs.append(packed(signature(items)) if len(items) else [0] * len(_PACKED))
        columns = [list(c) for c in zip(*signs, strict=True)] or [[] for _ in _PACKED]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "mark", "n", "digest", *_PACKED])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, digest, text: the sets of the texts that have the digest."""
    for batch in batches:
        found = [(node, items.view(np.int64)) for node, want, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if digest(items := shingles(text)) == want]
        ends = np.concatenate([[0], np.cumsum([len(x) for _, x in found])]).astype(np.int32)
        items = pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int64), *(x for _, x in found)]))
        parity = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * SKETCH, np.concatenate([np.zeros(0, np.int64), *(sketch(x) for _, x in found)]))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), items, parity], ["node", "items", "sketch"])


def sketch(items: np.ndarray) -> np.ndarray:
    """``SKETCH`` longs of parity bits, one for each residue of the items: sketches of two sets differ in at most as many bits as the
    sets have items that only one of them has."""
    odd = np.bincount(items & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def keys() -> Column:
    """An array of the keys of all chunks and choices."""
    value = lambda i: F.shiftright(F.col(f"s{i // 4}"), 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))
    out = []
    for c in range(CHUNKS):
        for k, rest in enumerate(combinations(range(PLACES), PLACES - ERRORS)):
            out.append(F.xxhash64(F.lit(c * 1000 + k), *[value(c * PLACES + i) for i in rest]))
    return F.array(*out)


def _spread(rows: DataFrame, few: DataFrame, on: str, by: str = "node") -> DataFrame:
    """``rows`` left-joined to ``few`` (a row each value of ``on``), where a value may have any share of the rows: each goes to ``SALTS``
    tasks, by the rows' ``by``."""
    salt = f"{TMP}salt"
    out = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)))
    return out.join(few.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [on, salt], "left").drop(salt)


def _counted(df: DataFrame, what: str) -> tuple[DataFrame, int]:
    """``df`` written, and its rows."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")), what)
    return out, seen.get["n"]


def components(links: DataFrame) -> DataFrame:
    """node and comp, the smallest node that ``links`` (a, b) lead to, for the nodes that have links.

    Every node hooks onto its smallest neighbour if that is smaller, hooks are followed ``JUMPS`` times, and the links are drawn between
    what remains, until none is left.  A path of any length takes logarithmically many turns.
    """
    edges, n = _counted(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    labels, hooks, used = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node")), [], [edges]
    while n:
        hook = edges.groupBy("b").agg(F.min("a").alias("up")).withColumn("least", F.col("up"))
        for _ in range(JUMPS):
            further = hook.select("up").distinct().join(hook.select(F.col("b").alias("up"), F.col("up").alias("beyond")), "up")
            hook = _spread(hook, further, "up", "b").select("b", "least", F.coalesce("beyond", "up").alias("up"))
        hook = written(hook, "hooks")
        # A link to the smallest neighbour is used up; as many of these as there may be bear one node, which needs no look-up.
        left = edges.join(hook, "b").where("a <> least").select("a", F.col("up").alias("b"))
        further = hook.select(F.col("b").alias("a"), F.col("up").alias("beyond"))
        left = left.join(further, "a", "left").select(F.coalesce("beyond", "a").alias("a"), "b")
        left = left.unionByName(hook.select(F.col("up").alias("a")).join(further, "a").select("a", F.col("beyond").alias("b")))  # hooks not followed to their end
        edges, n = _counted(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        few = hook.select(F.col("b").alias("comp"), "up")
        labels = (_spread(labels, few, "comp") if hooks else labels.join(few, "comp", "left")).select("node", F.coalesce("up", "comp").alias("comp"))
        hooks.append(hook), used.append(edges)
    labels = written(labels, "labels")
    dropped(*hooks, *used)
    return labels


def confirmed(pairs: DataFrame, sets: DataFrame, near: int = NEAR) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    # As a condition of the join: a node makes no more rows than there are links.
    return two.where(100 * both >= near * (F.size("x") + F.size("y") - both)).select("a", "b")


def _allowed(near: int, a: str, b: str) -> Column:
    """Whether two sets can be as similar as asked, by exact bounds: the intersection is at most the smaller count of shared shingles
    (m), and the items that only one set has are at least the bits in which the sketches differ."""
    both = F.col(f"{a}n") + F.col(f"{b}n")
    most = F.least(F.col(f"{a}m"), F.col(f"{b}m"))
    apart = sum((F.bit_count(F.get(f"{a}sketch", i).bitwiseXOR(F.get(f"{b}sketch", i))) for i in range(SKETCH)), F.lit(0))
    return (most * (100 + near) >= near * both) & (apart * (100 + near) <= (100 - near) * both)


_MEMBER = ("node", "n", "m", "sketch")


def _star(members: DataFrame, hub: Column, near: int) -> DataFrame:
    """The pair (a, b) of each member with its key's hub, where the bounds allow it and both aren't of one component (comp) yet."""
    known = [*_MEMBER, *(["comp"] if "comp" in members.columns else [])]
    hubs = members.groupBy("key").agg(hub.alias("h")).select(F.col("key").alias("h_key"), *[F.col(f"h.{c}").alias(f"h_{c}") for c in known])
    apart = F.col("comp") != F.col("h_comp") if "comp" in known else F.col("node") != F.col("h_node")
    star = members.join(hubs, (F.col("key") == F.col("h_key")) & apart & _allowed(near, "", "h_"))
    return star.select(F.least("node", "h_node").alias("a"), F.greatest("node", "h_node").alias("b")).distinct()


def rarest(sets: DataFrame, near: int) -> DataFrame:
    """node and key, for as many of a set's rarest items as a similar set may lack, and one more, that another set has too; ``head`` marks
    those that suffice where the other set isn't smaller, which then shares ``2 near / (100 + near)`` of this one at least."""
    items = sets.select("node", F.explode("items").alias("key"))
    counts = items.groupBy("key").agg(F.count("*").alias("c"))
    ordered = items.join(counts, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("x"))
    n = F.size("x")
    first = F.slice("x", F.lit(1), (n - F.ceil(n * near / 100) + 1).cast("int"))
    head = n - F.ceil(n * 2 * near / (100 + near)) + 1
    marked = F.transform(first, lambda x, i: F.struct(x["key"].alias("key"), x["c"].alias("c"), (i < head).alias("head")))
    return ordered.select("node", F.explode(F.filter(marked, lambda x: x["c"] > 1)).alias("x")).select("node", F.col("x.key").alias("key"), "x.head")


def _open_pairs(members: DataFrame, near: int) -> DataFrame:
    """The pairs of a key in different components that the bounds allow; of rarest items, those of the smaller set's head."""
    columns = ("key", *_MEMBER, "comp", *(["head"] if "head" in members.columns else []))
    left, right = (members.select(*[F.col(c).alias(f"{side}_{c}") for c in columns]) for side in "ab")
    met = (F.col("a_key") == F.col("b_key")) & (F.col("a_node") < F.col("b_node")) & (F.col("a_comp") != F.col("b_comp")) & _allowed(near, "a_", "b_")
    if "head" in columns:
        met = met & F.when(F.col("a_n") <= F.col("b_n"), F.col("a_head")).otherwise(F.col("b_head"))
    return left.join(right, met).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (node, comp) with more ``links`` (a, b), as links between components."""
    mine = lambda side: F.coalesce(F.col(f"{side}_comp"), F.col(side)).alias(side)
    sides = [comps.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_comp")) for side in "ab"]
    above = components(links.join(sides[0], "a", "left").join(sides[1], "b", "left").select(mine("a"), mine("b")))
    above = above.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
    new = comps.unionByName(above.select(F.col("comp").alias("node"), F.col("comp")).join(comps, "node", "left_anti"))  # nodes without a link until now
    return written(_spread(new, above, "comp").select("node", F.coalesce("up", "comp").alias("comp")), "labels")


def _placed(members: DataFrame, comps: DataFrame) -> DataFrame:
    """``members`` with the component of their node."""
    return members.drop("comp").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _linked(members: DataFrame, sets: DataFrame, near: int, group: int) -> DataFrame:
    """node and comp of the nodes that have links, from the members of keys."""
    first = written(confirmed(_star(members, F.min(F.struct(*_MEMBER)), near), sets, near), "links")
    # Members whose link to their key's least node is confirmed are done with that key; the least itself stands for them.
    hubs = members.groupBy("key").agg(F.min("node").alias("a"))
    done = members.select("key", F.col("node").alias("b")).join(hubs, "key").join(first, ["a", "b"]).select("key", F.col("b").alias("node"))
    rest = members.join(done, ["key", "node"], "left_anti")
    second = _star(rest, F.min_by(F.struct(*_MEMBER), F.xxhash64("node", "key")), near).join(first, ["a", "b"], "left_anti")
    second = written(confirmed(second, sets, near), "links")
    comps = components(first.unionByName(second))

    at = _placed(members, comps)
    still = at.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "c")
    open_ = written(at.join(still, "key"), "open")
    pairs = _open_pairs(open_.where(F.col("c") <= group), near)
    large = written(open_.where(F.col("c") > group).select(*_MEMBER, "comp").dropDuplicates(["node"]), "large")
    if not large.isEmpty():
        rare = written(rarest(sets.join(large, "node", "left_semi"), near).join(large, "node"), "rare")
        star = written(confirmed(_star(rare, F.min(F.struct(*_MEMBER, "comp")), near), sets, near), "links")
        if not star.isEmpty():
            comps = _merged(comps, star)
        pairs = pairs.unionByName(_open_pairs(_placed(rare, comps), near)).distinct()
        dropped(star)
    third = written(confirmed(pairs, sets, near), "links")
    dropped(first, second, open_, large)
    return comps if third.isEmpty() else _merged(comps, third)


def classes(docs: DataFrame, near: int = NEAR, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, n, digest) for all of ``docs``, ``mark`` being a hash of the text, and (digest, component) for all digests."""
    python_tasks(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = texts.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    signed = written(marked.mapInArrow(_signed, "doc_id long, mark long, n long, digest string, " + ", ".join(f"{c} long" for c in _PACKED)), "signatures")
    same = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in _PACKED])
    firsts = written(same.withColumn("node", F.monotonically_increasing_id()), "classes")
    keyed = firsts.select("node", F.explode(keys()).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("key")
    pairs = written(keyed.join(shared, "key"), "keys")
    some = written(firsts.join(pairs.select("node").distinct(), "node", "left_semi").select(F.col("id").alias("doc_id"), "node", "digest"), "some")
    ids = written(some.select("doc_id").distinct(), "ids")
    # Few ids, if so, thin out the texts before they move.  An id may have several texts; the class's set is the one with its digest.
    own = texts.join(ids, "doc_id", "left_semi").join(some, "doc_id").select("node", "digest", "text")
    sets = written(own.mapInArrow(_sets, "node long, items array<bigint>, sketch array<bigint>"), "sets")
    dropped(some, ids)
    # m: how many of a class's shingles another class in the tables has too.
    alone = sets.select("node", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("alone"))
    sized = sets.select("node", F.size("items").cast("long").alias("n"), "sketch").join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("m"), "sketch")
    members = written(pairs.join(sized.where(F.col("m") * 100 >= near * F.col("n")), "node"), "members")
    dropped(pairs)
    comps = _linked(members, sets, near, group)
    dropped(members, sets)
    least = comps.join(firsts.select("node", "id"), "node").groupBy("comp").agg(F.min("id").alias("component"))
    known = _spread(comps, least, "comp").select("node", "component")
    found = firsts.join(known, "node", "left").select("digest", F.coalesce("component", "id").alias("component"))
    return signed.select("doc_id", "mark", "n", "digest"), found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: set size, component and verdict of every document."""
    rows, found = classes(documents(spark, sf_dir))
    out = rows.join(found, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, near: int = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their text's component, with their own columns only; rows without an id stay."""
    rows, found = classes(docs, near, id_col, text_col)
    verdict = rows.join(found, "digest", "left").where((F.col("doc_id") == F.coalesce("component", "doc_id")) & F.col("doc_id").isNotNull())
    verdict = verdict.select(F.col("doc_id").alias(f"{TMP}id"), F.col("mark").alias(f"{TMP}mark")).distinct()
    kept = docs.join(verdict, (F.col(id_col).cast("long") == F.col(f"{TMP}id")) & (F.xxhash64(text_col) == F.col(f"{TMP}mark")), "left_semi")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
