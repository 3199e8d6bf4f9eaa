"""Cutting lineage with tables in the folder that all executors share.

A table written there survives the loss of any executor, carries its size (so later joins
choose their strategy from facts), and can be dropped as soon as its successor is written.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only for a local master without the setting."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if have:
        return have.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="kgspark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", "file://" + path)
    return "file://" + path


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written once to the shared folder and read back; the path is kept for ``drop``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    w = df.write.mode("error").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kgspark_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that ``cut`` writes inside are deleted at the end, when what they were for has been written."""
    mine: list[DataFrame] = []
    _scopes.append(mine)
    try:
        yield
    finally:
        _scopes.remove(mine)
        drop(*mine)


def drop(*frames: DataFrame | None) -> None:
    """Deletes tables made by ``cut`` that nothing needs any more."""
    for df in frames:
        path = getattr(df, "_kgspark_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            df._kgspark_path = None


def bytes_of(df: DataFrame) -> int:
    """Bytes on disk of a table made by ``cut``: a measured size, for deciding whether to broadcast."""
    jvm = df.sparkSession.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(df._kgspark_path)
    return p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
