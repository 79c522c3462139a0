"""Alignment of predictions with ground truth, and the accuracy of groups and templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import evaluation_key


#: Rows whose order one task checks; then the ends of such blocks are compared.
ORDER_BLOCK = 100_000


class AlignmentError(ValueError):
    """Ground truth and predictions do not hold the same lines."""


def check_rows(df: DataFrame, what: str, id_col: str = "LineId", template_col: str = "EventTemplate") -> None:
    """Raise if ids or templates are blank, ids repeat, or there are no rows."""
    blank = lambda c: F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""))
    n, bad_id, bad_template = df.agg(F.count("*"), blank(id_col), blank(template_col)).first()
    if not n:
        raise AlignmentError(f"{what} has no rows")
    if bad_id or bad_template:
        raise AlignmentError(f"{what} has {bad_id} blank ids and {bad_template} blank templates")
    twice = [r[0] for r in df.groupBy(id_col).count().where("count > 1").orderBy(id_col).limit(5).select(id_col).collect()]
    if twice:
        raise AlignmentError(f"{what} repeats ids such as {twice}")


def difference(truth: DataFrame, predicted: DataFrame, id_col: str = "LineId") -> DataFrame:
    """(side, id): ids that only one side has."""
    a, b = truth.select(F.col(id_col).alias("id")), predicted.select(F.col(id_col).alias("id"))
    return a.join(b, "id", "left_anti").select(F.lit("missing").alias("side"), "id").unionByName(b.join(a, "id", "left_anti").select(F.lit("extra").alias("side"), "id"))


def align(truth: DataFrame, predicted: DataFrame, id_col: str = "LineId", template_col: str = "EventTemplate", strict: bool = True) -> DataFrame:
    """(id, gt, pred) with comparison keys; strict raises on any id that only one side has."""
    if strict:
        check_rows(truth, "ground truth", id_col, template_col)
        check_rows(predicted, "predictions", id_col, template_col)
        odd = difference(truth, predicted, id_col).orderBy("side", "id").limit(5).collect()
        if odd:
            raise AlignmentError("ids do not match, such as " + ", ".join(f"{r['id']} ({r['side']})" for r in odd))
    a = truth.select(F.col(id_col).alias("id"), evaluation_key(F.col(template_col)).alias("gt"))
    b = predicted.select(F.col(id_col).alias("id2"), evaluation_key(F.col(template_col)).alias("pred"))
    return a.join(b, F.col("id") == F.col("id2")).drop("id2")


def contingency(aligned: DataFrame) -> DataFrame:
    """(gt, pred, n): everything that the scores need, one row per pair of labels."""
    return aligned.groupBy("gt", "pred").agg(F.count("*").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def scores(pairs: DataFrame) -> DataFrame:
    """One row of PA, GA, PGA, RGA, FGA, PTA, RTA, FTA and their counts from a contingency table.

    A group is matched when its label pair has all rows of both labels; a template is matched when all rows predicted
    as it truly are it. Windows over labels replace joins of marginals.
    """
    gt = pairs.groupBy(F.col("gt").alias("g")).agg(F.sum("n").alias("gt_n"))
    pr = pairs.groupBy(F.col("pred").alias("p")).agg(F.sum("n").alias("pred_n"))
    t = pairs.join(gt, F.col("gt") == F.col("g")).join(pr, F.col("pred") == F.col("p"))
    matched = (F.col("n") == F.col("gt_n")) & (F.col("n") == F.col("pred_n"))
    pure = (F.col("gt") == F.col("pred")) & (F.col("n") == F.col("pred_n"))
    one = t.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_distinct("gt").alias("gt_clusters"), F.count_distinct("pred").alias("pred_clusters"),
        F.coalesce(F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n"))), F.lit(0)).alias("equal"), F.coalesce(F.sum(F.when(matched, F.col("n"))), F.lit(0)).alias("grouped"),
        F.count_if(matched).alias("matched_clusters"), F.count_if(pure).alias("matched_templates"),
    )
    c, g, p = F.col("matched_clusters").cast("double"), F.col("gt_clusters"), F.col("pred_clusters")
    k = F.col("matched_templates").cast("double")
    return one.select(
        "rows", "gt_clusters", "pred_clusters", "matched_clusters", "matched_templates",
        _ratio(F.col("equal").cast("double"), F.col("rows")).alias("PA"), _ratio(F.col("grouped").cast("double"), F.col("rows")).alias("GA"),
        _ratio(c, p).alias("PGA"), _ratio(c, g).alias("RGA"), _ratio(2 * c, p + g).alias("FGA"), _ratio(k, p).alias("PTA"), _ratio(k, g).alias("RTA"), _ratio(2 * k, p + g).alias("FTA"),
    )


def evaluate(truth: DataFrame, predicted: DataFrame, **columns) -> DataFrame:
    return scores(contingency(align(truth, predicted, **columns)))


def order_report(truth: DataFrame, predicted: DataFrame, id_col: str = "LineId", order_col: str = "idx") -> DataFrame:
    """One row: whether both sides list the same ids in the same order, and whether ids rise as numbers."""
    a = truth.select(F.col(id_col).alias("id"), F.col(order_col).alias("o"))
    b = predicted.select(F.col(id_col).alias("id2"), F.col(order_col).alias("o2"))
    moved = a.join(b, (F.col("id") == F.col("id2")), "full_outer").agg(F.count_if(~F.col("o").eqNullSafe(F.col("o2"))).alias("n"))
    number = F.expr("try_cast(id as bigint)")
    local = a.withColumns({"n": number, "block": F.floor(F.col("o") / ORDER_BLOCK)})
    step = local.withColumn("was", F.lag("n").over(W.partitionBy("block").orderBy("o")))
    inner = step.agg(F.count_if(F.col("n").isNull() | (F.col("was") >= F.col("n"))).alias("n"))
    ends = local.groupBy("block").agg(F.min_by("n", "o").alias("first"), F.max_by("n", "o").alias("last"))
    across = ends.withColumn("was", F.lag("last").over(W.orderBy("block"))).agg(F.count_if(F.col("was") >= F.col("first")).alias("n"))
    found = moved.withColumn("what", F.lit("moved")).unionByName(inner.withColumn("what", F.lit("order"))).unionByName(across.withColumn("what", F.lit("order")))
    total = lambda w: F.sum(F.when(F.col("what") == w, F.col("n"))) == 0
    return found.agg(total("moved").alias("order_equal"), total("order").alias("increasing"))


def id_samples(df: DataFrame, id_col: str = "LineId", order_col: str = "idx", n: int = 3) -> DataFrame:
    """One row: the first n and the last n ids in order; all of the first n only when there are at most 2 n rows."""
    first = df.orderBy(order_col).limit(n).select(F.col(order_col).alias("o"), F.col(id_col).alias("id"), F.lit("first").alias("side"))
    last = df.orderBy(F.desc(order_col)).limit(n).select(F.col(order_col).alias("o"), F.col(id_col).alias("id"), F.lit("last").alias("side"))
    rows = df.agg(F.count("*").alias("rows")).select(F.lit(None).cast("long").alias("o"), F.lit(None).cast("string").alias("id"), F.lit("count").alias("side"), "rows")
    every = first.unionByName(last).withColumns({"o": F.col("o").cast("long"), "id": F.col("id").cast("string"), "rows": F.lit(None).cast("long")}).unionByName(rows)
    pick = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("o", "id")))), lambda s: s["id"])
    one = every.agg(F.max("rows").alias("rows"), pick("first").alias("first_ids"), pick("last").alias("last_ids"))
    return one.select("rows", "first_ids", F.when(F.col("rows") > 2 * n, F.col("last_ids")).otherwise(F.col("first_ids")).alias("last_ids"))
