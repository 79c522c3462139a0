"""Token-set distances within buckets and the cutoff that they suggest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |a & b| / |a | b| of token arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.size(F.array_intersect(a, b)) / union)


def pair_distances(df: DataFrame) -> DataFrame:
    """(bucket, i, j, d) for all pairs i < j of a bucket, by a join on the bucket: the items are a model's training strings,
    whose number is bounded, and complete linkage needs every distance."""
    sets = df.select("bucket", "idx", F.array_distinct("tokens").alias("set"))
    left = sets.select("bucket", F.col("idx").alias("i"), F.col("set").alias("a"))
    right = sets.select(F.col("bucket").alias("b2"), F.col("idx").alias("j"), F.col("set").alias("b"))
    pairs = left.join(right, (F.col("bucket") == F.col("b2")) & (F.col("i") < F.col("j")))
    return pairs.select("bucket", "i", "j", jaccard_distance(F.col("a"), F.col("b")).alias("d"))


def elbow_cutoffs(pairs: DataFrame, min_similarity: float) -> DataFrame:
    """(bucket, pairs, cutoff): the distance at the elbow of a bucket's sorted distances, at most 1 - min_similarity.

    The elbow is the first place k with the largest |k * V - (d_k - d_0) * H|, H = number of pairs - 1, V = spread. One
    pair gives its own distance, whatever the limit. Equal distances are counted before they are ordered, so a task
    sorts a bucket's different distances only; within such a run the extreme lies at one of its ends.
    """
    runs = pairs.groupBy("bucket", "d").agg(F.count("*").alias("n"))
    by = W.partitionBy("bucket")
    end = F.sum("n").over(by.orderBy("d"))
    runs = runs.withColumns({"end": end, "total": F.sum("n").over(by), "low": F.min("d").over(by), "high": F.max("d").over(by)})
    far = lambda k: F.abs(k * (F.col("high") - F.col("low")) - (F.col("d") - F.col("low")) * (F.col("total") - 1))
    first, last = (F.col("end") - F.col("n")), F.col("end") - 1
    best = F.struct(F.greatest(far(first), far(last)).alias("v"), (-F.when(far(first) >= far(last), first).otherwise(last)).alias("k"))
    g = runs.groupBy("bucket").agg(F.max("total").alias("pairs"), F.max_by("d", best).alias("at"))
    cutoff = F.when(F.col("pairs") == 1, F.col("at")).otherwise(F.least(F.col("at"), F.lit(1.0 - min_similarity)))
    return g.select("bucket", "pairs", cutoff.alias("cutoff"))
