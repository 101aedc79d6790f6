"""WARC archives with a Merkle fixity audit.

Pages become WARC response records, dealt to files of ``FILE`` consecutive ids and laid out by id, so a record has a file, a rank and an
offset range.  A leaf of the hash tree is the digest of a record's bytes; a node hashes the offset range it covers and its children in
order, ``FAN`` of them: first the records of a file, then the files.  Two replicas are compared from the roots down: only children of
nodes that differ are looked at, level by level, until the records that differ are found.  Both trees are as high as the higher one
needs, so one with fewer records or files has single children on its left edge.

Building a level is one aggregation of groups of at most ``FAN`` rows; descending joins a level to the few nodes that differ above it.

Defined cases: a null url or html is empty; a null id is no record and is dropped; repeated ids lie one after another in order of their
bytes; a record or file that only one replica has differs; equal replicas stop at the root; empty archives are equal and have no records;
other columns, of any name, don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, written

#: Consecutive ids of a file, and children of a node.
FILE, FAN = 256, 16


def record(url: Column, html: Column, key: Column) -> Column:
    """The bytes of one response record."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), key.cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.encode(F.concat(head, body, F.lit("\r\n\r\n")), "UTF-8")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per record: page_id, file, rank, offset, length, digest.  The bytes stay behind; only their digests move."""
    raw = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("page_id"), record(F.col(url_col), F.col(html_col), F.col(id_col)).alias("bytes"))
    rows = raw.select("page_id", F.floor(F.col("page_id") / FILE).cast("long").alias("file"), F.octet_length("bytes").cast("long").alias("length"), F.sha2("bytes", 256).alias("digest"))
    order = Window.partitionBy("file").orderBy("page_id", "digest")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).withColumn("offset", before)


def leaves(records: DataFrame) -> DataFrame:
    """The lowest level of a tree: (file, node, start, end, hash), a node being a rank."""
    return written(records.select("file", F.col("rank").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), F.col("digest").alias("hash")), "leaves")


def heights(leaf: DataFrame) -> tuple[int, int]:
    """Levels of nodes that the records of the longest file need, and that the files need."""
    most = leaf.agg(F.max("node"), F.max(F.abs("file"))).first()
    return tuple(next(h for h in range(64) if (x or 0) < FAN**h) for x in most)


def tree(leaf: DataFrame, within: int, above: int) -> tuple[list[DataFrame], int]:
    """Levels from the records up to the root, each (file, node, start, end, hash), and the place of the level of files.

    Nodes of a file are numbered by rank; above the files they are numbered by file, at file -1.
    """
    up = F.floor(F.col("node") / FAN).cast("long")
    levels = [leaf]
    for _ in range(within):
        levels.append(written(_parents(levels[-1].withColumn("up", up), "file"), "nodes"))
    levels.append(levels[-1].select(F.lit(-1).cast("long").alias("file"), F.col("file").alias("node"), "start", "end", "hash"))
    for _ in range(above + 1):
        levels.append(written(_parents(levels[-1].withColumn("up", up), "file"), "nodes"))
    # Nodes 0 and -1 may both be left where ids have both signs; one root holds them.
    levels.append(written(_parents(levels[-1].withColumn("up", F.lit(0).cast("long")), "file"), "root"))
    return levels, within + 1


def _parents(children: DataFrame, file: str) -> DataFrame:
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "start", "end", "hash"))), lambda x: F.concat_ws(":", x["node"].cast("string"), x["start"].cast("string"), x["end"].cast("string"), x["hash"])), ";")
    return children.groupBy(file, F.col("up").alias("node")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sha2(parts.cast("binary"), 256).alias("hash")).select("file", "node", "start", "end", "hash")


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes whose hash or range differs, or that one side has alone."""
    x = a.select("file", "node", F.struct("start", "end", "hash").alias("x"))
    y = b.select("file", "node", F.struct("start", "end", "hash").alias("y"))
    return x.join(y, ["file", "node"], "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("file", "node")


def audit(one: DataFrame, two: DataFrame) -> tuple[DataFrame, list[int]]:
    """Records (file, rank) that differ between two archives, and how many nodes differed at each level from the root down."""
    low = [leaves(one), leaves(two)]
    within, above = (max(x) for x in zip(*map(heights, low), strict=True))
    (first, file_level), (second, _) = (tree(leaf, within, above) for leaf in low)
    top, counts = len(first) - 1, []
    bad = written(_differing(first[top], second[top]), "differing")
    for level in range(top, 0, -1):
        counts.append(bad.count())
        if not counts[-1]:
            bad = bad.limit(0)
            break
        if level == file_level:  # from a file's place among files to the file's own top
            down = bad.select(F.col("node").alias("file"), F.lit(0).cast("long").alias("node"))
        else:
            parents = bad.select("file", F.col("node").alias("up"))
            step = (lambda df: df.withColumn("up", F.lit(0).cast("long"))) if level == top else (lambda df: df.withColumn("up", F.floor(F.col("node") / FAN).cast("long")))
            down = _differing(*[step(t[level - 1]).join(parents, ["file", "up"], "left_semi").select("file", "node", "start", "end", "hash") for t in (first, second)])
        after = written(down, "differing")
        dropped(bad)
        bad = after
    else:
        counts.append(bad.count())
    dropped(*first, *second)
    return bad.select("file", F.col("node").alias("rank")), counts


def damaged(pages: DataFrame) -> DataFrame:
    """A replica in which every 97th page, from id 13 on, has its first character overwritten: something for the audit to find."""
    hit = F.col("page_id") % 97 == 13
    return pages.withColumn("html", F.when(hit, F.concat(F.lit("\x00"), F.substring(F.coalesce("html", F.lit("")), 2, 2**31 - 1))).otherwise(F.col("html")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every record of the archive of ``pages``, and whether the audit of a damaged replica locates it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    records = written(archive(pages), "records")
    found, _ = audit(records, archive(damaged(pages)))
    out = records.join(found.withColumn("located", F.lit(True)), ["file", "rank"], "left")
    return out.select("page_id", "file", "offset", "length", F.col("digest").alias("record_sha256"), F.coalesce("located", F.lit(False)).alias("located"))


ORACLE = r"""
WITH r AS (
  SELECT page_id, CAST(floor(page_id / 256) AS BIGINT) AS file, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM pages)
SELECT page_id, file, CAST(coalesce(sum(strlen(rec)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       strlen(rec) AS length, sha256(rec) AS record_sha256, page_id % 97 = 13 AS located
FROM r
"""
