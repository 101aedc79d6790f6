"""Document fingerprints: SimHash, and permuted block tables to search them.

Terms are adjacent word pairs (the word itself where a text has one word), each weighted by how often it occurs.  Every term has a
128-bit hash; a bit of the fingerprint is set if more than half of the weight has it set.  Votes are counted two bits to a long, in
32-bit lanes, so a row carries 64 longs through one aggregation, which needs no shuffle where rows already lie by their key.

Search: the bits are cut into ``BLOCKS`` blocks.  Two fingerprints within ``radius`` bits agree in all but ``radius`` blocks at
least, so a table for every choice of agreeing blocks, keyed by their bits, finds all such pairs.  Equal fingerprints are one entry
of the tables.  The query searches the tables for the fingerprints of every ``EVERY``-th id.

Everything is DataFrame expressions.

Defined cases: a null or empty text has no terms and the fingerprint of zeros; a bit with exactly half of the weight is unset; equal
texts have equal fingerprints; repeated rows and ids are each kept; of documents with equal ids the next one is of the next lower id,
and of several texts of an id the greatest is the next text; a document without an id has no next one, its edited text loses its last
half, and it is not searched for; an empty table gives an empty result; other columns, of any name, don't take part.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TMP, documents, text_of, words_of, written

BITS = 128
BLOCKS = 5
RADIUS = 3
#: Ids divisible by this are searched for.
EVERY = 20
_LANES = 0x0000000100000001


def votes(rows: DataFrame, text_col: str, key: list[str]) -> DataFrame:
    """``key`` and the fingerprint of ``text_col`` as two longs, ``bits0`` and ``bits1``; a row per distinct ``key``."""
    terms = rows.select(*key, F.transform(words_of(text_of(text_col)), lambda x: F.xxhash64(x)).alias(f"{TMP}w"))
    w, i = F.col(f"{TMP}w"), F.col(f"{TMP}i")
    terms = terms.select(*key, f"{TMP}w", F.explode_outer(F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - 2, F.lit(0))))).alias(f"{TMP}i"))
    a, b = F.get(w, i), F.get(w, i + 1)
    terms = terms.select(*key, F.when(i.isNotNull(), F.xxhash64(a, b)).alias(f"{TMP}h0"), F.when(i.isNotNull(), F.xxhash64(b, F.lit(7), a)).alias(f"{TMP}h1"))
    each = [F.sum(F.shiftright(F.col(f"{TMP}h{k}"), i).bitwiseAND(F.lit(_LANES))).alias(f"{TMP}v{k}_{i}") for k in (0, 1) for i in range(32)]
    counted = terms.groupBy(*key).agg(F.count(f"{TMP}h0").alias(f"{TMP}n"), *each)
    low, longs = F.lit(0xFFFFFFFF), []
    for k in (0, 1):
        bits = F.lit(0).cast("long")
        for i in range(32):
            v = F.col(f"{TMP}v{k}_{i}")
            bits = bits.bitwiseOR(F.when(2 * v.bitwiseAND(low) > F.col(f"{TMP}n"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
            top = 1 << (i + 32) if i < 31 else -(1 << 63)
            bits = bits.bitwiseOR(F.when(2 * F.shiftrightunsigned(v, 32) > F.col(f"{TMP}n"), F.lit(top)).otherwise(F.lit(0)).cast("long"))
        longs.append(bits.alias(f"bits{k}"))
    return counted.select(*key, *longs)


def _hex(bits0: Column, bits1: Column) -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(x), 16, "0")) for x in (bits0, bits1)])


def fingerprint(rows: DataFrame, text_col: str, key: list[str], name: str) -> DataFrame:
    """``key`` and the fingerprint of ``text_col`` as 32 hex digits; a row per distinct ``key``."""
    return votes(rows, text_col, key).select(*key, _hex(F.col("bits0"), F.col("bits1")).alias(name))


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints, eight hex digits at a time."""
    part = lambda x, k: F.conv(F.substring(x, k, 8), 16, 10).cast("long")
    return sum((F.bit_count(part(a, k).bitwiseXOR(part(b, k))) for k in range(1, BITS // 4, 8)), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    return (1.0 - distance(a, b) / float(BITS)).cast("double")


def near(queries: DataFrame, entries: DataFrame, radius: int = RADIUS, fingerprint_col: str = "fingerprint") -> DataFrame:
    """All pairs (``query``, ``entry``, ``distance``) of distinct fingerprints within ``radius``, by the block tables.

    Both sides are made distinct first, so copies cost nothing.  ``radius`` must be below ``BLOCKS``.
    """
    if not 0 <= radius < BLOCKS:
        raise ValueError(f"the radius must be below {BLOCKS}")
    digits = BITS // 4
    cuts = [digits * b // BLOCKS for b in range(BLOCKS + 1)]

    def tables(df: DataFrame, name: str) -> DataFrame:
        fp = F.col(name)
        keys = [F.concat(F.lit(f"{t}:"), *[F.substring(fp, cuts[b] + 1, cuts[b + 1] - cuts[b]) for b in blocks]) for t, blocks in enumerate(combinations(range(BLOCKS), BLOCKS - radius))]
        return df.select(F.col(fingerprint_col).alias(name)).where(F.col(name).isNotNull()).distinct().select(name, F.explode(F.array(*[F.xxhash64(k) for k in keys])).alias("key"))

    apart = distance(F.col("query"), F.col("entry"))
    one, two = tables(queries, "query"), tables(entries, "entry").withColumnRenamed("key", "entry_key")
    pairs = one.join(two, (F.col("key") == F.col("entry_key")) & (apart <= radius))  # as a condition, so that only pairs that are near leave the join
    return pairs.select("query", "entry", apart.alias("distance")).distinct()


def next_ids(ids: DataFrame) -> DataFrame:
    """Distinct ``doc_id`` with ``next_id``: the next lower one; after the least, the greatest.

    Ids are dealt to buckets of ``doc_id div width``; within a bucket the next id is its neighbour, and the bucket's least id looks
    to the next bucket that has rows.  Buckets of buckets do the same, so no window holds more than ``2**12`` rows.  Ids may span 2**63 at most.
    """
    level = written(ids.where(F.col("doc_id").isNotNull()).select("doc_id").distinct(), "ids")
    bits = 12

    def lead(rows: DataFrame, depth: int) -> DataFrame:
        """rows: doc_id (the greatest of a cell), cell.  Adds next_id, null for the last."""
        up = rows.withColumn("up", F.shiftright("cell", bits))
        within = up.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("up").orderBy(F.col("doc_id").desc())))
        if depth == 0:
            return within.select("doc_id", "cell", "next_id")
        above = lead(up.groupBy("up").agg(F.max("doc_id").alias("doc_id")).select("doc_id", F.col("up").alias("cell")), depth - 1).select(F.col("cell").alias("up"), F.col("next_id").alias("beyond"))
        return within.join(above, "up", "left").select("doc_id", "cell", F.coalesce("next_id", "beyond").alias("next_id"))

    ends = level.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    least = ends["a"] or 0
    depth = max(0, -(-((ends["b"] or 0) - least).bit_length() // bits) - 1)
    out = lead(level.select("doc_id", (F.col("doc_id") - least).alias("cell")), depth)
    return out.select("doc_id", F.coalesce("next_id", F.lit(ends["b"]).cast("long")).alias("next_id"))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``edited``: the last half of the text replaced by the start of the next document's.

    Only as much of the next text is sent as a text can take: its first half of the asking text's length.
    """
    # Both joins take ``rows`` with the same columns and keys, so that its texts are shuffled once.  Rows without an id find no head; a
    # salt spreads them.
    k, salt, zero = f"{TMP}k", f"{TMP}salt", F.lit(0).cast("long")
    key = F.col("doc_id") if docs.schema["doc_id"].dataType == T.LongType() else F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(key, text_of().alias("text"))
    rows = rows.withColumns({k: F.coalesce("doc_id", zero), salt: F.when(F.col("doc_id").isNull(), F.xxhash64("text").bitwiseOR(F.lit(1))).otherwise(zero)})
    known = rows.where(F.col("doc_id").isNotNull())
    ids = written(next_ids(known.select("doc_id")).withColumn(salt, zero), "next")  # read from the table, so that no plan folds it
    halves = known.select("doc_id", F.floor(F.length("text") / 2).cast("int").alias("half"))
    repeated = known.count() > ids.count()
    if repeated:
        halves = halves.groupBy("doc_id").agg(F.max("half").alias("half"))
    asked = halves.join(ids, "doc_id").select(F.col("next_id").alias(k), salt, F.col("doc_id").alias("asker"), "half")
    heads = rows.join(asked, [k, salt]).select(F.col("asker").alias(k), asked[salt], F.col("doc_id").alias("next_id"), F.substring(F.col("text"), F.lit(1), F.col("half")).alias("head"))
    if repeated:  # of several texts of the next id, the greatest
        heads = heads.groupBy(k, salt, "next_id").agg(F.max("head").alias("head"))
    out = rows.join(heads, [k, salt], "left")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    head = F.substring(F.coalesce("head", F.lit("")), F.lit(1), half)
    return out.select("doc_id", "next_id", "text", F.concat(F.substring(F.col("text"), F.lit(1), n - half), head).alias("edited"), k, salt)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: fingerprints of every document and its edited text; ``n_near``: distinct fingerprints in the block tables within ``RADIUS``
    of the document's, its own included, for ids divisible by ``EVERY`` (others: null)."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    side = lambda k, c: F.struct(F.lit(k).alias("side"), F.col(c).alias("text"))
    base = [f"{TMP}k", f"{TMP}salt", "doc_id", "next_id", "row", "n_chars", "edited_sha256"]
    rows = edited(docs).withColumns({"row": F.monotonically_increasing_id(), "n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2(F.col("edited"), 256)})
    rows = rows.select(*base, F.explode(F.array(side(0, "text"), side(1, "edited"))).alias("x")).select(*base, F.col("x.side").alias("side"), F.col("x.text").alias("text"))
    marks = votes(rows, "text", [*base, "side"])
    of = lambda k: _hex(*[F.max(F.when(F.col("side") == k, F.col(b))) for b in ("bits0", "bits1")])
    pairs = written(marks.groupBy(*base).agg(of(0).alias("fingerprint"), of(1).alias("edited_fingerprint")).select("doc_id", "next_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"), "fingerprints")
    asked = F.coalesce(F.col("doc_id") % EVERY == 0, F.lit(False))
    found = near(pairs.where(asked), pairs).groupBy("query").agg(F.count("*").alias("n_near"))
    after = pairs.groupBy(F.col("doc_id").alias("next_id")).agg(F.max("fingerprint").alias("next_fingerprint"))
    searched = pairs.where(asked).join(found, F.col("fingerprint") == F.col("query"), "left").drop("query")
    out = searched.unionByName(pairs.where(~asked).withColumn("n_near", F.lit(None).cast("long"))).join(after, "next_id", "left")
    fp = F.col("fingerprint")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(fp, F.col("edited_fingerprint")).alias("near_edited"), likeness(fp, F.coalesce("next_fingerprint", fp)).alias("near_next"), "n_near"
    )
