"""What the operators of this subpackage share: word rules, the shared folder, written tables.

Names of working columns start with ``TMP`` so that they cannot clash with columns of the input.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship

TMP = "__t_"
#: Separators of words: space and U+0009 to U+000D.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Words as an array of strings."""
    return F.array_remove(F.split(text, GAP), "")


def n_words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the context's own; a temporary one only where neither is set and everything runs in
    one process on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Tables that ``written`` has left, by path, with their sessions.
_left: dict[str, SparkSession] = {}


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    It cuts the lineage and outlives lost executors: a task that is run again reads the table, not its makers.  ``dropped`` deletes it;
    what is left then goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _left[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave, once nothing reads them any more; other DataFrames are left alone."""
    for path in [p for t in tables if (p := getattr(t, "_tessera_path", None)) in _left]:
        _delete(path)


def _delete(path: str) -> None:
    spark = _left.pop(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _tidy() -> None:
    for path in list(_left):
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(path)


def python_tasks(spark: SparkSession) -> None:
    """What tasks in Python need: this package, and Arrow batches of bounded size, since one text may have megabytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
