"""Helpers shared by the training-data operators: shared staging, checked joins, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import collecting, drop_staged, shared_dir, stage, stage_path

__all__ = ["collecting", "components", "dimension", "drop_staged", "same", "shared_dir", "stage", "stage_path", "word_count"]

#: Dimension tables of at most this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 10_000
#: Tables of more edges have their minima staged, so that joins on a hub can be split.
SPLIT_ROWS = 10_000
#: Words are maximal runs of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def dimension(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it is counted to have at most max_rows rows; df should be staged."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of the named columns (right's carry the prefix d_)."""
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[f"d_{n}"])
    return cond


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null: each word with the space after it becomes one character."""
    body = F.regexp_replace(text, r"^[\x20\x09-\x0D]++", "")
    return F.coalesce(F.length(F.regexp_replace(body, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")), F.lit(0)).cast("long")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of undirected edges by alternating large-star and small-star steps.

    Returns (node, root) for every node that is not its component's smallest. Each round is staged, so lineage
    stays short; the number of rounds grows with the logarithm of the longest chain.
    """
    x, y = F.col(a), F.col(b)
    spark, last, mark = edges.sparkSession, [], None
    with collecting(last):
        e = stage(edges.where(x != y).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct(), "cc")
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if now[0] == 0 or now == mark:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        mark, made = now, []
        with collecting(made):
            both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
            least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
            if now[0] > SPLIT_ROWS:  # else the join below keeps the aggregate's partitions, which Spark cannot split
                least = stage(least, "ccleast")
            large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
            large = stage(large, "cclarge")
            small = large.groupBy(F.col("hi").alias("w")).agg(F.min("lo").alias("m"))
            if now[0] > SPLIT_ROWS:
                small = stage(small, "ccsmall")
            joined = large.join(small, F.col("hi") == F.col("w"))
            star = joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(small.select(F.col("w").alias("hi"), F.col("m").alias("lo")))
            e = stage(star.distinct(), "cc")
        drop_staged(spark, [*last, *made[:-1]])  # only the newest round is needed
        last = made[-1:]
