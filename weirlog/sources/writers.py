"""Predictions, metric tables and run records; Spark's committer makes each write appear as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["LineId", "Content", "EventId", "EventTemplate"]


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def predictions(parsed: DataFrame) -> DataFrame:
    """(LineId, Content, EventId, EventTemplate, idx) of a parsed table."""
    return parsed.select("LineId", "Content", F.col("event_id").alias("EventId"), F.col("event_template").alias("EventTemplate"), "idx")


def write_predictions(parsed: DataFrame, path: str, by_line: bool = False) -> None:
    """Predictions as CSV, in input order or by numeric LineId; rows are range-partitioned, so files are in order too."""
    p = predictions(parsed)
    order = F.expr("try_cast(LineId as bigint)") if by_line else F.col("idx")
    write_csv(p.orderBy(order).select(*COLUMNS), path)


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, then new; columns that one side lacks are null."""
    if old is None:
        return new
    match = None
    other = new.select(*[F.col(k).alias(f"new_{k}") for k in keys]).distinct()
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"new_{k}"))
        match = c if match is None else match & c
    return old.join(other, match, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> None:
    """Upsert into a Parquet table at path: the result is written beside it and takes its place when it is whole.

    The old table is moved aside first and deleted last; a stop between leaves it at `path` + "-old", where the next
    call finds it.
    """
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path
    target, beside, aside = hadoop(path), hadoop(f"{path}-{uuid.uuid4().hex}"), hadoop(f"{path}-old")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(aside):  # an earlier call was stopped
        if fs.exists(target):
            fs.delete(aside, True)
        elif not fs.rename(aside, target):
            raise OSError(f"could not move the old table back to {path}")
    old = spark.read.parquet(path) if fs.exists(target) else None
    upsert(old, new, keys).write.parquet(beside.toString())
    if old is not None and not fs.rename(target, aside):
        raise OSError(f"could not move the old table at {path} aside")
    if not fs.rename(beside, target):
        raise OSError(f"could not move the new table to {path}")
    if old is not None:
        fs.delete(aside, True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def run_summary(runs: DataFrame) -> DataFrame:
    """One flat row for each run record."""
    return runs.select("run_id", "dataset", "quadrant", "config_hash", "rows", "metrics.PA", "metrics.GA", "metrics.FGA", "metrics.FTA", "bucket_count", "cluster_count", "template_count", "sampling_protocol", F.col("timing_seconds")["total"].alias("total_seconds"))
