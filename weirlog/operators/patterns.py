"""Templates by mining each position of a cluster: token types and values decide what becomes a wildcard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semantic_type

WILDCARD = "<*>"
VARIABLE = ("number", "ip", "path", "url", "hex")
DIVERSE, TAIL_SHARE = 0.3, 0.2


def mine_patterns(df: DataFrame) -> DataFrame:
    """(cluster_id, log_count, template) of (idx, tokens, cluster_id).

    A position that every message has becomes a wildcard if its tokens differ in type, or are of a variable type (or
    literal and over DIVERSE different) and differ in value; else its most frequent token stays, ties by first
    appearance. A later position becomes one if over TAIL_SHARE of the messages have it. Wildcards in a row are one. A
    single message is its own template. Tokens are counted before they are gathered, so a group holds counts only.
    """
    size = df.groupBy("cluster_id").agg(F.count("*").alias("log_count"), F.min(F.size("tokens")).alias("least"), F.min_by("tokens", "idx").alias("first_tokens"))
    each = df.select("cluster_id", "idx", F.posexplode("tokens").alias("pos", "token"))
    values = each.groupBy("cluster_id", "pos", "token").agg(F.count("*").alias("n"), F.min("idx").alias("at"))
    values = values.withColumn("type", semantic_type(F.col("token")))
    types = values.groupBy("cluster_id", "pos", "type").agg(F.sum("n").alias("n"), F.min("at").alias("at"), F.count("*").alias("values"), F.max_by("token", F.struct("n", -F.col("at"))).alias("value"), F.max(F.struct("n", -F.col("at"))).alias("best"))
    order = F.struct("n", -F.col("at"))
    place = types.groupBy("cluster_id", "pos").agg(
        F.count("*").alias("types"), F.sum("n").alias("messages"), F.sum("values").alias("values"), F.max_by("type", order).alias("type"), F.max_by("value", F.col("best")).alias("value"),
    )
    place = place.join(size, "cluster_id")
    many = F.col("values") > 1
    general = (F.col("types") > 1) | (F.col("type").isin(*VARIABLE) & many) | ((F.col("type") == "literal") & (F.col("values") / F.col("messages") > DIVERSE))
    inside = F.col("pos") < F.col("least")
    token = F.when(inside, F.when(general, F.lit(WILDCARD)).otherwise(F.col("value"))).when(F.col("messages") > F.col("log_count") * TAIL_SHARE, F.lit(WILDCARD))
    parts = place.select("cluster_id", "pos", token.alias("token")).where("token is not null")
    merged = parts.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("parts"))
    step = lambda a, p: F.when((F.size(a) > 0) & (F.element_at(a, -1) == WILDCARD) & (p["token"] == WILDCARD), a).otherwise(F.concat(a, F.array(p["token"])))
    text = F.array_join(F.aggregate("parts", F.array().cast("array<string>"), lambda a, p: F.when(F.size(a) == 0, F.array(p["token"])).otherwise(step(a, p))), " ")
    mined = merged.select(F.col("cluster_id").alias("c"), text.alias("mined"))
    out = size.join(mined, F.col("cluster_id") == F.col("c"), "left")
    alone = F.array_join("first_tokens", " ")
    return out.select("cluster_id", "log_count", F.when(F.col("log_count") == 1, alone).otherwise(F.coalesce("mined", F.lit(""))).alias("template"))
