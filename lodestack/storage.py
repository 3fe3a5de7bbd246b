"""Shared scratch storage and bounded broadcasts.

Internal columns of the library start with ``_ls_`` so that they never clash with columns of the caller's table.
"""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A frame is broadcast only if it has been counted and has no more rows than this.
BROADCAST_ROWS = 300_000


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local master may go without that setting; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(spark, "_ls_scratch", None):
        spark._ls_scratch = tempfile.mkdtemp(prefix="lodestack-")
    return spark._ls_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the session ends."""
    path = f"{scratch_dir(spark)}/lodestack-{label}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def save(df: DataFrame, label: str, hashes: bool = False) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    ``hashes``: the columns are mostly random numbers, which neither dictionaries nor compression make smaller.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false") if hashes else df.write
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._ls_path = path
    if _scopes():
        _scopes()[-1].append(path)
    return out


_local = threading.local()


def _scopes() -> list[list[str]]:
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Tables that are saved inside go at the end, but those that the given function is called with.

    What is still to be computed afterwards must depend on kept tables only.
    """
    paths: list[str] = []
    _scopes().append(paths)

    def keep(df: DataFrame) -> DataFrame:
        if df._ls_path in paths:
            paths.remove(df._ls_path)
            if len(_scopes()) > 1:
                _scopes()[-2].append(df._ls_path)
        return df

    try:
        yield keep
    finally:
        _scopes().remove(paths)
        for path in paths:
            _delete(spark, path)


def discard(df: DataFrame) -> None:
    """Deletes a saved table that nothing depends on any more."""
    for paths in _scopes():
        if df._ls_path in paths:
            paths.remove(df._ls_path)
    _delete(df.sparkSession, df._ls_path)


def same_table(df: DataFrame, saved: DataFrame) -> DataFrame:
    """``df``, a projection of a saved table, as one that scopes can keep."""
    df._ls_path = saved._ls_path
    return df


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a saved frame for broadcast if its counted rows are within ``limit``; beyond, the join shuffles."""
    return F.broadcast(df) if df.count() <= limit else df
