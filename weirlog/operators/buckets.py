"""Positional entropy, anchors and buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bucket_key, tokens


def items(masked: DataFrame) -> DataFrame:
    """(idx, masked, tokens) of (idx, masked)."""
    return masked.select("idx", "masked", tokens(F.col("masked")).alias("tokens"))


def frequencies(masked: DataFrame) -> DataFrame:
    """How often each masked string occurs and where first: (masked, n, first_idx)."""
    return masked.groupBy("masked").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))


def top_strings(masked: DataFrame, k: int = 8_000) -> DataFrame:
    """The k most frequent strings, ties by first appearance, as training items (idx = rank, masked, n)."""
    best = frequencies(masked).orderBy(F.desc("n"), "first_idx").limit(k)
    rank = F.row_number().over(W.orderBy(F.desc("n"), "first_idx")) - 1
    return best.select(rank.cast("long").alias("idx"), "masked", "n")


def position_counts(df: DataFrame, max_positions: int) -> DataFrame:
    """(pos, token, n) over the first positions of every message."""
    head = df.select(F.posexplode(F.slice("tokens", 1, max_positions)).alias("pos", "token"))
    return head.groupBy("pos", "token").agg(F.count("*").alias("n"))


def positional_entropy(df: DataFrame, max_positions: int) -> DataFrame:
    """Shannon entropy in bits of the tokens at each position, over the messages that reach it: (pos, messages, entropy)."""
    counts = position_counts(df, max_positions)
    total = F.sum("n")
    # -sum(p log p) with p = n / total, in one aggregate; a position of one token has none, whatever rounding says
    entropy = F.when(F.count("*") == 1, F.lit(0.0)).otherwise(F.log2(total.cast("double")) - F.sum(F.col("n") * F.log2("n")) / total)
    return counts.groupBy("pos").agg(total.alias("messages"), entropy.alias("entropy"))


def anchors(entropy: DataFrame, threshold: float) -> list[int]:
    """Positions with less entropy than the threshold; a bounded list of small numbers."""
    return sorted(r["pos"] for r in entropy.where(F.col("entropy") < threshold - 1e-12).select("pos").collect())


def with_bucket(df: DataFrame, positions: list[int]) -> DataFrame:
    return df.withColumn("bucket", bucket_key(F.col("tokens"), positions))


def bucket_sizes(df: DataFrame) -> DataFrame:
    """(bucket, n, first_idx), buckets in order of appearance by first_idx."""
    return df.groupBy("bucket").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))
