"""Where driver and executors write for each other."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_written: dict[str, set[str]] = {}  # by application, the paths that were given out and are still there


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the one set by ``setCheckpointDir``.

    Only where neither is set and all runs on one machine, as in tests, a temporary folder takes its place. On a
    cluster that raises, as executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        folder = tempfile.mkdtemp(prefix="pagewright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_dir.append(f"file://{folder}")
    return _own_dir[0]


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else has, among those that ``release`` removes."""
    path = f"{shared_dir(spark)}/pagewright/{tag}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def store(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again: what is used several times is made once, and an executor's loss costs none of it. It stays until ``release``."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Removes files or folders."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _written.get(spark.sparkContext.applicationId, set()).discard(path)


def written(spark: SparkSession) -> frozenset[str]:
    """The paths in the shared folder that were given out in this application and are still there."""
    return frozenset(_written.get(spark.sparkContext.applicationId, ()))


def release(spark: SparkSession, keep: frozenset[str] = frozenset()) -> None:
    """Removes all that was written and left for results, but for ``keep``; call it when these are read."""
    remove(spark, *written(spark).difference(keep))
