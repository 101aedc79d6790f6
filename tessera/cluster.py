"""Sending this package to the executors of a cluster, and tables between the steps of an operator."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, and keeps Arrow batches small, since one text may have megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._tessera_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the context's own; a temporary one only where neither is set and Spark is one local process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_held: dict[str, SparkSession] = {}


def held(df: DataFrame, what: str, **parquet: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: made once, whatever reads it, and not lost with an executor.  It goes when
    the driver ends, or by ``released``.  ``parquet``: settings of its writer."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{what}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | parquet).parquet(path)
    _held[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_held = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes tables that ``held`` gave, once nothing reads them any more."""
    for path in [p for t in tables if (p := getattr(t, "_tessera_held", None)) in _held]:
        _delete(path)


def _delete(path: str) -> None:
    spark = _held.pop(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _tidy() -> None:
    for path in list(_held):
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(path)
