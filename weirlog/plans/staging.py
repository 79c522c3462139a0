"""Cutting lineage through the folder that driver and executors share, and joins with small tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 60_000

_fallback: dict[str, str] = {}
_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, as in tests, a temporary folder where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _fallback.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="weirlog-"))
    return path.rstrip("/")


def stage_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; it is deleted with the staged tables."""
    path = f"{shared_dir(spark)}/weirlog-{tag}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and survives lost executors."""
    path = stage_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete the given staged tables (all of this process if None), once no result built on them is needed any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in list(_staged if paths is None else paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        if p in _staged:
            _staged.remove(p)
    if paths is not None:
        paths.clear()


@contextlib.contextmanager
def collecting(paths: list[str]) -> Iterator[None]:
    """Note in paths the tables that are staged meanwhile."""
    n = len(_staged)
    try:
        yield
    finally:
        paths += _staged[n:]


@atexit.register
def _at_exit() -> None:
    """Results end with the process, and so do the tables that they were built on."""
    spark = SparkSession.getActiveSession() if _staged else None
    if spark is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            drop_staged(spark)


def dimension(df: DataFrame, max_rows: int = BROADCAST_ROWS, bound: int | None = None) -> DataFrame:
    """df, marked for broadcast only if it has at most max_rows rows: by a known bound, else by counting."""
    small = bound <= max_rows if bound is not None else df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df
