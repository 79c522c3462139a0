"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dimension, same, stage, word_count

#: About as many documents share one bucket of a source's key space; a bucket is the unit that one task sorts.
BUCKET_ROWS = 1_000
#: Steps a unit in which weights are told apart where buckets are cut.
GRAIN = 100
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 17


def quality_weight(text: F.Column) -> F.Column:
    """Share of letters among the text's characters, at least 0.05: junk is drawn less often than prose."""
    letters = F.length(F.regexp_replace(text, r"\P{L}++", ""))
    return F.coalesce(F.greatest(letters.cast("double") / F.greatest(F.length(text), F.lit(1)), F.lit(0.05)), F.lit(0.05))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of (source, source_size): shares of all words by weight, none above max_epochs times its source's size.

    Sources take the weights in turn, by code point, null last. Resharing the excess until no target is above its
    limit ends at a common level: target = min(limit, weight * level). Ordered by limit / weight, the limited sources
    come first, so running sums give the level without a loop.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(int(w)) for w in weights])
    t = sizes.withColumn("weight", F.element_at(turn, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    t = t.withColumn("limit", F.col("source_size") * max_epochs)
    rising = W.orderBy((F.col("limit").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    t = t.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("share", F.sum("weight").over(rising.rowsBetween(0, W.unboundedFollowing)))
    t = t.withColumn("level", F.col("rest").cast("double") / F.col("share"))
    t = t.withColumn("at", F.max(F.when(F.col("limit") > F.col("weight") * F.col("level"), F.col("level"))).over(every))
    target = F.least(F.col("limit").cast("double"), F.col("weight") * F.coalesce(F.col("at"), F.lit(0.0)))
    return t.select("source", "source_size", target.alias("target"))


def _sources(d: DataFrame) -> DataFrame:
    """(source, source_size, n, rates): rates are the different weights, in steps of 1/GRAIN, and their documents."""
    shares = d.groupBy("source", F.round(F.col("w") * GRAIN).alias("step")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.avg("w").alias("rate"))
    return shares.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("rate", "n"))).alias("rates"))


def _bucket() -> Column:
    """The bucket of a key: the share of its source's documents whose keys are expected to be smaller, times the buckets."""
    above = F.aggregate("rates", F.lit(0.0), lambda a, r: a + r["n"] * F.exp(-F.col("key") * r["rate"])) / F.col("n")
    return F.greatest(F.least(F.floor((1 - above) * F.col("buckets")), F.col("buckets") - 1), F.lit(0)).cast("long")


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, cut: bool = True, carry: bool = False,
) -> DataFrame:
    """How many words of each document a mixture takes.

    A document's key is -ln(u) / w, u a hash of its id and size as a uniform number, w its quality weight. A source
    takes floor(target / size) whole epochs, then its documents by rising key while their prefix sum lies within what
    is left. With cut, the document at the budget's edge gives just the words that are missing; without, it is taken
    whole if at least half of it lies within.

    A source's key range is split into buckets of equal expected size, by the keys' distribution under the source's own
    weights (in steps of 1/GRAIN): bucket totals are summed first (one row a bucket), then each bucket is sorted in its
    own task, so no task holds a whole source.

    Null text: size 0, taken 0. Null source: a source of its own, last in order. Null and repeated ids: rows with equal
    key, id and size are interchangeable; each is counted. Empty table: no rows. Other columns are not read.
    With carry, the document's own columns come along in a struct `row`, at the price of shuffling them.
    Returns (doc_id, source, size, source_size, target, epochs, taken).
    """
    text = F.col(text_col)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), quality_weight(text).alias("w"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("size").cast("string"))), 1, 13), 16, 10)
    d = d.withColumn("key", -F.log((draw.cast("double") + 0.5) / float(2**52)) / F.col("w"))
    d = stage(d, "mix")
    by = stage(_sources(d), "mixsrc")
    t = source_targets(by.select("source", "source_size"), weights, max_epochs)
    t = t.withColumnRenamed("source", "d_source")
    plan = by.join(t.drop("source_size"), by["source"].eqNullSafe(t["d_source"])).drop("d_source")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("left", budget - F.col("epochs") * F.col("source_size"))
    plan = stage(plan.withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS).cast("long")), "mixplan")
    dim = dimension(plan.withColumnRenamed("source", "d_source"))
    d = d.join(dim, same(d, dim, "source")).drop("d_source")
    d = d.withColumn("bucket", _bucket()).drop("rates")
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("base", F.sum("words").over(W.partitionBy("source").orderBy("bucket")) - F.col("words"))
    sums = sums.select(F.col("source").alias("d_source"), F.col("bucket").alias("d_bucket"), "base")
    d = d.join(sums, same(d, sums, "source", "bucket")).drop("d_source", "d_bucket")
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("before", F.col("base") + F.sum("size").over(inside) - F.col("size"))
    if cut:
        extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before")))
    else:
        extra = F.when(2 * F.col("before") + F.col("size") <= 2 * F.col("left"), F.col("size")).otherwise(0)
    taken = F.col("epochs") * F.col("size") + extra
    return d.select("doc_id", "source", "size", "source_size", "target", "epochs", taken.cast("long").alias("taken"), *(["row"] if carry else []))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(greatest(length(regexp_replace(text, '\P{L}+', '', 'g'))::DOUBLE / greatest(length(text), 1), 0.05), 0.05) AS w
  FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / w AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
t AS (SELECT *, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::BIGINT AS weight, 3 * source_size AS lim FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(lim) OVER (ORDER BY lim::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
    / (sum(weight) OVER (ORDER BY lim::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM t),
a AS (SELECT max(CASE WHEN lim > weight * level THEN level END) AS top_level FROM l),
g AS (SELECT source, source_size, least(lim::DOUBLE, weight * coalesce(top_level, 0.0)) AS target FROM l, a),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM g),
r AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, floor(p.target)::BIGINT - p.epochs * p.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - k.size AS before
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM r
"""
