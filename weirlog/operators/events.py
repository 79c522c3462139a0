"""Events: templates that are the same under a key, numbered by size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import template_key


def with_events(rows: DataFrame, key: Callable[[Column], Column] = template_key) -> DataFrame:
    """rows (cluster_id, log_count, template, ...) with event_ord, event_id and event_template; a cluster may have several rows.

    Clusters are taken by falling size, then id; a key's first cluster names its event and gives its template; events
    are E1, E2, ... in this order. The last window orders all rows in one task: at most as many as a model is trained on.
    """
    order, by = F.struct(-F.col("log_count"), F.col("cluster_id")), W.partitionBy("key")
    t = rows.withColumn("key", key(F.col("template")))
    t = t.withColumns({"o": F.min(order).over(by), "event_template": F.min_by("template", order).over(by)})
    t = t.withColumn("event_ord", F.dense_rank().over(W.orderBy("o")))
    return t.withColumn("event_id", F.concat(F.lit("E"), F.col("event_ord").cast("string"))).drop("key", "o")


def number_events(templates: DataFrame, key: Callable[[Column], Column] = template_key) -> DataFrame:
    """(cluster_id, event_ord, event_id, event_template) of (cluster_id, log_count, template)."""
    return with_events(templates, key).select("cluster_id", "event_ord", "event_id", "event_template")
