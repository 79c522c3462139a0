"""Error analysis and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import evaluation_key


def with_event_id(df: DataFrame) -> DataFrame:
    """Where no EventId is given, the template is the id."""
    return df if "EventId" in df.columns else df.withColumn("EventId", F.col("EventTemplate"))


def joined_errors(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(id, content, gt_id, gt_template, pred_id, pred_template, correct) of lines that both sides have."""
    a = with_event_id(truth).select(F.col("LineId").alias("id"), F.col("Content").alias("content"), F.col("EventId").alias("gt_id"), F.col("EventTemplate").alias("gt_template"))
    b = with_event_id(predicted).select(F.col("LineId").alias("id2"), F.col("EventId").alias("pred_id"), F.col("EventTemplate").alias("pred_template"))
    j = a.join(b, F.col("id") == F.col("id2")).drop("id2")
    return j.withColumn("correct", evaluation_key(F.col("gt_template")) == evaluation_key(F.col("pred_template")))


def error_pairs(joined: DataFrame) -> DataFrame:
    """(gt_template, pred_template, errors, sample) of wrong lines, most frequent first when ordered by errors."""
    bad = joined.where(~F.col("correct"))
    return bad.groupBy("gt_template", "pred_template").agg(F.count("*").alias("errors"), F.min_by("content", F.expr("cast(id as bigint)")).alias("sample"))


def spread_groups(joined: DataFrame, by: str, of: str) -> DataFrame:
    """Groups of `by` that hold more than one `of`: over-merged predictions or over-split truths."""
    return joined.groupBy(by).agg(F.count_distinct(of).alias("different"), F.count("*").alias("n")).where("different > 1")


def worst_group(joined: DataFrame, by: str, of: str, template: str) -> DataFrame:
    """The group that mixes most, with the first three different templates in it."""
    worst = spread_groups(joined, by, of).orderBy(F.desc("different"), F.desc("n"), by).limit(1)
    inside = joined.join(worst.select(F.col(by).alias("w"), "different"), F.col(by) == F.col("w"))
    firsts = inside.groupBy(by, "different", template).agg(F.min(F.expr("cast(id as bigint)")).alias("at")).orderBy("at", template).limit(3)
    return firsts.groupBy(by, "different").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", template))), lambda s: s[template]).alias("templates"))


def mean_metrics(results: DataFrame) -> DataFrame:
    """Means over data sets; runs without FTA count in the others only."""
    return results.agg(*[F.avg(c).alias(c) for c in ("PA", "GA", "FGA", "FTA", "EPS")], F.count("FTA").alias("with_fta"), F.count("*").alias("runs"))


def throughput(rows: F.Column, seconds: F.Column) -> F.Column:
    return F.round(F.when(seconds > 0, rows / seconds).otherwise(0.0), 2)


def compare_runs(left: DataFrame, right: DataFrame, key: str = "Dataset", metrics: tuple[str, ...] = ("FGA", "EPS")) -> DataFrame:
    """One row: how often and by how much the left run beats the right one on data sets that both have."""
    b = right.select(F.col(key).alias("k"), *[F.col(m).alias(f"{m}_r") for m in metrics])
    j = left.join(b, F.col(key) == F.col("k"))
    return j.agg(F.count("*").alias("both"), *[x for m in metrics for x in (F.count_if(F.col(m) > F.col(f"{m}_r")).alias(f"{m}_wins"), F.avg(F.col(m) - F.col(f"{m}_r")).alias(f"{m}_gain"))])


def variant_means(results: DataFrame, metric: str = "FGA") -> DataFrame:
    return results.groupBy("Variant").agg(F.avg(metric).alias(f"mean_{metric}"))


def pivot_metric(results: DataFrame, datasets: list[str], metric: str = "FGA") -> DataFrame:
    """Variant by data set, 0 where a run is missing."""
    return results.groupBy("Variant").pivot("Dataset", datasets).agg(F.first(metric)).na.fill(0.0, datasets)


def drop_from_baseline(results: DataFrame, baseline: str = "Baseline", metric: str = "FGA") -> DataFrame:
    """(Variant, Dataset, fall, percent): how far each variant falls below the baseline on a data set."""
    base = results.where(F.col("Variant") == baseline).select(F.col("Dataset").alias("d"), F.col(metric).alias("base"))
    j = results.where(F.col("Variant") != baseline).join(base, F.col("Dataset") == F.col("d"))
    fall = F.col("base") - F.col(metric)
    return j.select("Variant", "Dataset", fall.alias("fall"), F.when(F.col("base") == 0, F.lit(0.0)).otherwise(fall / F.col("base") * 100).alias("percent"))
