"""A directory as one sorted CSV file: scored updates are merged into it, and the file is replaced whole or not at all.

The writer is a Python data source.  Tasks get the rows by ranges of the key, sort them, and leave a part each in a folder beside the file.
The commit checks that no part is missing and that their ranges follow one another, puts the parts together in a new file, keeps a
copy of the old one, and renames the new one.  An abort, or a commit that fails, removes the parts and leaves the file as it was.
The folder must be one that driver and executors share.

Defined cases: rows with equal keys raise ValueError, and so do two rows with one link (in any case, but for a slash at the end); null is blank;
an empty table is a file with its header; a file that isn't there yet has no copy; fields with a comma, a quote or a line break are quoted;
line ends are CRLF.
"""

from __future__ import annotations

import csv
import datetime
import io
import os
import shutil
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..cluster import ship
from ..functions import text as T
from ..operators import linkage
from .files import KEY

#: Bytes that the commit copies at once.
CHUNK = 1 << 20
#: Fixed value: the least score at which a row is updated.
LEAST_SCORE = 140


@dataclass
class _Part(WriterCommitMessage):
    path: str
    first: tuple
    last: tuple
    rows: int
    crc: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, names: list[str], key: list[str], copies: str | None):
        self.path, self.names, self.key, self.copies = path, names, key, copies
        self.staging = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        place = [self.names.index(k) for k in self.key]
        rows = sorted((["" if v is None else str(v) for v in r] for r in iterator), key=lambda r: [r[i] for i in place])
        if not rows:
            return _Part("", (), (), 0, 0)
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator="\r\n").writerows(rows)
        data = out.getvalue().encode()
        os.makedirs(self.staging, exist_ok=True)
        path = f"{self.staging}/{uuid.uuid4().hex}"
        with open(path, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        of = lambda r: tuple(r[i] for i in place)
        return _Part(path, of(rows[0]), of(rows[-1]), len(rows), zlib.crc32(data))

    def commit(self, messages: list) -> None:
        new = f"{self.path}.new-{uuid.uuid4().hex}"
        try:
            if any(m is None for m in messages):
                raise ValueError("a part is missing")
            parts = sorted((m for m in messages if m.rows), key=lambda m: m.first)
            if any(a.last >= b.first for a, b in zip(parts, parts[1:])):
                raise ValueError("parts overlap: rows must come by ranges of the key, and keys be unique")
            with open(new, "wb") as out:
                header = io.StringIO(newline="")
                csv.writer(header, lineterminator="\r\n").writerow(self.names)
                out.write(header.getvalue().encode())
                for part in parts:
                    crc = 0
                    with open(part.path, "rb") as f:
                        while data := f.read(CHUNK):
                            crc = zlib.crc32(data, crc)
                            out.write(data)
                    if crc != part.crc:
                        raise ValueError(f"{part.path} isn't what its task wrote")
                out.flush()
                os.fsync(out.fileno())
            if self.copies and os.path.exists(self.path):
                os.makedirs(self.copies, exist_ok=True)
                stem, dot = os.path.splitext(os.path.basename(self.path))
                shutil.copy2(self.path, f"{self.copies}/{stem}.{datetime.datetime.now():%Y%m%dT%H%M%S%f}{dot}")
            os.replace(new, self.path)
        finally:
            if os.path.exists(new):
                os.unlink(new)
            shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class DirectoryFile(DataSource):
    """``format("directory_file")``; options: path, key (columns, comma-joined), copies (a folder for copies of the old file)."""

    @classmethod
    def name(cls) -> str:
        return "directory_file"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema.names, self.options["key"].split(","), self.options.get("copies"))


def write(rows: DataFrame, path: str, key: tuple[str, ...] = KEY, link: str | None = "Website_Link", copies: str | None = None, parts: int | None = None) -> None:
    """Replaces the file by ``rows``, sorted by ``key`` in the order of code points.  ``link``: a column whose filled values must be unique."""
    spark = rows.sparkSession
    ship(spark)
    if not rows.groupBy(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]).count().where("count > 1").isEmpty():
        raise ValueError("the key is not unique")
    if link:
        folded = F.lower(F.regexp_replace(F.trim(F.col(link)), "/+$", ""))
        if not rows.where(folded != "").groupBy(folded).count().where("count > 1").isEmpty():
            raise ValueError(f"{link} is shared by two rows")
    spark.dataSource.register(DirectoryFile)
    ordered = rows.na.fill("").repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *key)
    out = ordered.write.format("directory_file").mode("append").option("path", path).option("key", ",".join(key))
    (out.option("copies", copies) if copies else out).save()


def merged(directory: DataFrame, updates: DataFrame, row: str, update: str, block: list[str], rules: list[tuple[Column, float]], fields: list[str], identity: Column | None = None, insert: Column | None = None, least: float = LEAST_SCORE) -> tuple[DataFrame, DataFrame]:
    """``directory`` after scored updates, and a log (update, row, score, action).

    Each update goes to the row of the best score, ``least`` at least, among those that share one of ``block`` (columns of blocking keys that both
    tables have); ``rules`` are conditions on columns ``d_*`` and ``u_*`` with their scores.  An update for which ``identity`` holds for just one
    row goes to that row, whatever its score.  Filled values overwrite; of two updates of a row the smaller id writes last.  Updates without a row
    become rows where ``insert`` holds.
    """
    d = directory.select(*[F.col(c).alias(f"d_{c}") for c in directory.columns])
    u = updates.select(*[F.col(c).alias(f"u_{c}") for c in updates.columns])
    met = None
    for b in block:
        pairs = u.where(T.blank_to_null(F.col(f"u_{b}").cast("string")).isNotNull()).join(d, F.col(f"u_{b}") == F.col(f"d_{b}")).select(f"u_{update}", f"d_{row}")
        met = pairs if met is None else met.unionByName(pairs)
    pairs = met.distinct().join(u, f"u_{update}").join(d, f"d_{row}")
    own = F.coalesce(identity, F.lit(False)) if identity is not None else F.lit(False)
    score = sum((F.when(F.coalesce(c, F.lit(False)), F.lit(float(s))).otherwise(F.lit(0.0)) for c, s in rules), F.lit(0.0))
    pairs = pairs.withColumns({"own": own, "score": score})
    pairs = pairs.withColumn("n_own", F.sum(F.col("own").cast("int")).over(Window.partitionBy(f"u_{update}")))
    pairs = pairs.withColumn("sure", F.col("own") & (F.col("n_own") == 1))
    pairs = pairs.withColumn("score", F.when(F.col("sure"), F.greatest("score", F.lit(float(least)))).otherwise(F.col("score")))
    best = F.row_number().over(Window.partitionBy(f"u_{update}").orderBy(F.col("sure").desc(), F.col("score").desc(), f"d_{row}"))
    chosen = pairs.where(F.col("score") >= least).withColumn("r", best).where("r = 1").select(F.col(f"u_{update}").alias(update), F.col(f"d_{row}").alias(row), "score")

    written = chosen.join(updates.select(update, *fields), update)
    newest = [F.max_by(F.col(f), F.when(T.blank_to_null(F.col(f)).isNotNull(), F.struct(F.lit(1).alias("a"), (-F.col(update)).alias("b")))).alias(f) for f in fields]
    after = linkage.upsert(directory.select(row, *fields), written.groupBy(row).agg(*newest), row, fields).drop("action")
    kept = directory.drop(*fields).join(after, row)
    new = updates.join(chosen, update, "left_anti").where(F.coalesce(insert, F.lit(False)) if insert is not None else F.lit(False))
    # Columns that updates lack are blank in new rows.
    added = new.select(*[(F.lit(None).cast(directory.schema[c].dataType) if c == row or c not in updates.columns else F.col(c)).alias(c) for c in directory.columns])
    log = updates.select(update).join(chosen, update, "left").join(new.select(F.col(update), F.lit(1).alias("_new")), update, "left")
    log = log.select(update, row, "score", F.when(F.col(row).isNotNull(), "updated").when(F.col("_new") == 1, "inserted").otherwise("unmatched").alias("action"))
    return kept.select(*directory.columns).unionByName(added), log
