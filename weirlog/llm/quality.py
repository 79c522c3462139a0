"""Quality rules: base statistics and robust multivariate outliers (minimum covariance determinant), native functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, dimension, same, stage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A language and source (else a language, else all) with fewer documents has no estimate of its own.
MIN_GROUP = 30
#: Share of a group's documents that its estimate rests on.
CORE = 0.5
#: Concentration steps from each start, and at most how many more from the start with the smallest determinant.
FIRST_STEPS, STEPS = 2, 20
#: Steps end when no group's log determinant changes by more.
SETTLED = 1e-3
#: Reject beyond the distance that this share of normal documents keeps within.
REACH = 0.999
#: Transformed statistics and the standard deviation below which none is taken as known; f_lines (at most 1) and f_repeat
#: (at most sqrt(0.5)) can each pass the limit alone.
FEATURES = {"f_length": 0.08, "f_symbols": 0.05, "f_lines": 0.18, "f_repeat": 0.13, "f_upper": 0.05, "f_marks": 0.04}
#: Standard deviation of normal data over their median absolute deviation.
NORMAL_MAD = 1.4826
#: Histogram steps a unit, for medians and quantiles that do not depend on the order of rows.
GRAIN = 256


def _chi2_share(x: float, degrees: int) -> float:
    """Share of the chi-square distribution below x, for even degrees of freedom."""
    return 1.0 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def _chi2(share: float, degrees: int) -> float:
    """Quantile of the chi-square distribution, for even degrees of freedom, by bisection."""
    low, high = 0.0, 1_000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_share(mid, degrees) < share else (low, mid)
    return low


def _covered(hashes: Column) -> Column:
    """Sorted (hash, position) pairs, or null when no two hashes are equal."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base statistics of whole texts; repeats are found by sorting a text's window hashes, n log n in its length."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col("lang").alias("lang"), F.col("source").alias("source"), text.alias("text"))
    d = d.withColumn("words", F.transform(F.filter(F.split("text", SPACE), lambda w: w != ""), lambda w: F.xxhash64(w)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("lines", lines)
    d = d.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]++", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("text", r"\P{Lu}++", "")).cast("long").alias("n_upper"),
        (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).cast("long").alias("n_marks"),
        F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2))).alias("windows"),
    )
    d = d.withColumn("pairs", _covered(F.col("windows"))).drop("windows")
    at = lambda i: F.get("pairs", i)["h"]
    twice = F.filter("pairs", lambda s, i: ((i > 0) & (at(F.greatest(i - 1, F.lit(0))) == s["h"])) | ((i + 1 < F.size("pairs")) & (at(i + 1) == s["h"])))
    d = d.withColumn("places", F.sort_array(F.transform(twice, lambda s: s["p"]))).drop("pairs")
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
    total = F.aggregate("places", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), step, lambda a: a["n"])
    return d.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("places")


def _features(d: DataFrame) -> DataFrame:
    words, chars = F.greatest("n_words", F.lit(1)).cast("double"), F.greatest("word_chars", F.lit(1)).cast("double")
    return d.withColumns({
        "f_length": F.log(chars / words), "f_symbols": F.sqrt(F.col("n_symbols") / chars),
        "f_lines": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)).cast("double")),
        "f_repeat": F.sqrt(F.col("n_repeat_words") / words), "f_upper": F.sqrt(F.col("n_upper") / chars), "f_marks": F.sqrt(F.col("n_marks") / chars),
    })


def _quantile(d: DataFrame, keys: list[str], value: Column, share: float, name: str) -> DataFrame:
    """The share-quantile of value by keys, to 1/GRAIN, from a histogram."""
    h = d.groupBy(*keys, F.round(value * GRAIN).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    up = F.sum("n").over(W.partitionBy(*keys).orderBy("bin"))
    h = h.withColumns({"up": up, "all": F.sum("n").over(W.partitionBy(*keys))})
    return h.where(F.col("up") >= F.ceil(F.lit(share) * F.col("all"))).groupBy(*keys).agg((F.min("bin") / F.lit(float(GRAIN))).alias(name))


def _whiten(prefix: str = "") -> Column:
    """Squared Mahalanobis distance of the features from m_* under covariance c_*_*, by an unrolled Cholesky factor."""
    names, low, y, total = list(FEATURES), {}, [], F.lit(0.0)
    for i, a in enumerate(names):
        rest = F.col(a) - F.col(f"m_{a}")
        for j in range(i):
            rest = rest - F.col(f"l_{a}_{names[j]}") * y[j]
        y.append(rest / F.col(f"l_{a}_{a}"))
        total = total + y[-1] * y[-1]
    return total


def _estimate(near: DataFrame, core: float, *keys: str) -> DataFrame:
    """Mean and Cholesky factor of the covariance by keys, its diagonal raised by the squared floors, and its log determinant.

    The covariance of the core share nearest to the centre is first scaled to that of the whole, as for normal data.
    """
    names = list(FEATURES)
    wider = core / _chi2_share(_chi2(core, len(names)), len(names) + 2)
    sums = [F.count("*").alias("n")] + [F.sum(a).alias(f"s_{a}") for a in names]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(names) for b in names[: i + 1]]
    g = near.groupBy(*keys).agg(*sums).withColumns({f"m_{a}": F.round(F.col(f"s_{a}") / F.col("n"), 9) for a in names})
    cov = {}
    for i, a in enumerate(names):
        for b in names[: i + 1]:
            c = F.round((F.col(f"s_{a}_{b}") / F.col("n") - F.col(f"m_{a}") * F.col(f"m_{b}")) * wider, 9)
            cov[f"c_{a}_{b}"] = c + FEATURES[a] ** 2 if a == b else c
    g = g.withColumns(cov)
    for j, b in enumerate(names):
        for i in range(j, len(names)):
            a = names[i]
            v = F.col(f"c_{a}_{b}")
            for k in range(j):
                v = v - F.col(f"l_{a}_{names[k]}") * F.col(f"l_{b}_{names[k]}")
            v = F.sqrt(F.greatest(v, F.lit((0.3 * FEATURES[a]) ** 2))) if i == j else v / F.col(f"l_{b}_{b}")
            g = g.withColumn(f"l_{a}_{b}", v)
    log_det = F.lit(0.0)
    for a in names:
        log_det = log_det + 2 * F.log(f"l_{a}_{a}")
    return g.select(*keys, *_PARTS, F.round(log_det, 9).alias("log_det"))


#: Columns of an estimate: means and the lower triangle of the Cholesky factor.
_PARTS = [f"m_{a}" for a in FEATURES] + [f"l_{a}_{b}" for i, a in enumerate(FEATURES) for b in list(FEATURES)[: i + 1]]


#: Groups up to which tables of estimates (three rows a group at most, 28 numbers each) are broadcast.
SMALL_GROUPS = 10_000


def _attach(d: DataFrame, g: DataFrame, *keys: str, small: bool = False) -> DataFrame:
    """d with g's columns; small: g holds estimates of at most SMALL_GROUPS groups, which was counted before."""
    keys = keys or ("grp",)
    g = g.withColumnsRenamed({k: f"d_{k}" for k in keys})
    g = F.broadcast(g) if small else g
    return d.join(g, same(d, g, *keys), "left").drop(*[f"d_{k}" for k in keys])


def _starts(wide: DataFrame, small: bool) -> DataFrame:
    """(grp, start, m_*, l_*): medians with the floors as scale, medians with median absolute deviations, mean and covariance."""
    long = wide.select("grp", F.explode(F.create_map(*[x for a in FEATURES for x in (F.lit(a), F.col(a))])).alias("name", "value"))
    mid = stage(_quantile(long, ["grp", "name"], F.col("value"), 0.5, "mid"), "qualitymid")
    off = _quantile(_attach(long, mid, "grp", "name", small=small), ["grp", "name"], F.abs(F.col("value") - F.col("mid")), 0.5, "off")
    both = mid.join(off, ["grp", "name"]).groupBy("grp").pivot("name", list(FEATURES)).agg(F.first("mid").alias("mid"), F.first("off").alias("off"))
    means = [F.col(f"{a}_mid").alias(f"m_{a}") for a in FEATURES]

    def diagonal(start: str, scale: Callable[[str], Column]) -> DataFrame:
        factor = [(scale(a) if a == b else F.lit(0.0)).alias(f"l_{a}_{b}") for i, a in enumerate(FEATURES) for b in list(FEATURES)[: i + 1]]
        return both.select("grp", F.lit(start).alias("start"), *means, *factor)

    floors = diagonal("floors", lambda a: F.lit(FEATURES[a]))
    deviations = diagonal("deviations", lambda a: F.greatest(F.lit(FEATURES[a]), F.col(f"{a}_off") * NORMAL_MAD))
    moments = _estimate(wide, 1.0, "grp").select("grp", F.lit("moments").alias("start"), *_PARTS)
    return floors.unionByName(deviations).unionByName(moments)


def _step(wide: DataFrame, est: DataFrame, core: float, small: bool, *more: str) -> DataFrame:
    """One concentration step: the estimate from the core share of each group that is nearest to est; more: key of several starts."""
    far = _attach(wide, est, small=small).withColumn("d2", _whiten()).select("grp", *more, *FEATURES, "d2")
    edge = _quantile(far, ["grp", *more], F.sqrt("d2"), core, "edge")
    near = _attach(far, edge, "grp", *more, small=small).where(F.round(F.sqrt("d2") * GRAIN) <= F.col("edge") * GRAIN)
    return stage(_estimate(near, core, "grp", *more), "qualityest")


def _concentrate(wide: DataFrame, core: float, steps: int, small: bool = False) -> DataFrame:
    """(grp, m_*, l_*, log_det): of several starts the one with the smallest determinant after some steps, then steps until it settles."""
    est = stage(_starts(wide, small), "qualityest")
    for _ in range(FIRST_STEPS):
        est = _step(wide, est, core, small, "start")
    best = est.groupBy("grp").agg(F.min_by(F.struct(*_PARTS, "log_det"), F.struct("log_det", "start")).alias("best"))
    est = stage(best.select("grp", "best.*"), "qualityest")
    for _ in range(steps):
        new = _step(wide, est, core, small)
        moved = _attach(new.select("grp", "log_det"), est.select("grp", F.col("log_det").alias("before")), small=small).agg(F.max(F.abs(F.col("log_det") - F.col("before")))).first()[0]
        est = new
        if (moved or 0.0) <= SETTLED:
            break
    return est


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", core: float = CORE, steps: int = STEPS, reach: float = REACH) -> DataFrame:
    """Base rules, then the minimum-covariance-determinant rule within each language and source.

    Each group's estimate has three fixed starts: medians with the floors as scale, medians with median absolute
    deviations, mean and covariance. In a concentration step the CORE share of a group nearest to its centre gives the next
    centre and covariance. After FIRST_STEPS the start with the smallest determinant is taken on, until no group's log
    determinant moves by more than SETTLED, in at most `steps`. A document is rejected when its squared
    Mahalanobis distance is over the chi-square quantile of `reach`, times the median correction: the squared distance
    that CORE of its group keeps within over the chi-square quantile of CORE, at least 1. Documents that fail the base rules do not take part in estimates. Groups under MIN_GROUP use their language, then all documents.
    Only sums and histograms by group are shuffled after the statistics are staged.

    Null text: an empty text (base_failed). Null language or source: groups of their own. Repeated rows count each.
    Empty table: no rows. Returns (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, distance, limit).
    """
    d = _features(statistics(docs, id_col, text_col))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    d = stage(d.withColumn("base_failed", failed), "quality")
    good = d.where(~F.col("base_failed"))
    n = stage(good.groupBy("lang", "source").agg(F.count("*").alias("n")), "qualityn")
    n = n.withColumn("of_lang", F.sum("n").over(W.partitionBy("lang")))
    pair = F.to_json(F.array(F.coalesce("lang", F.lit("\0")), F.coalesce("source", F.lit("\0"))))
    tongue = F.to_json(F.array(F.coalesce("lang", F.lit("\0"))))
    grp = F.when(F.col("n") >= MIN_GROUP, pair).when(F.col("of_lang") >= MIN_GROUP, tongue).otherwise(F.lit("[]"))
    n = stage(n.select(F.col("lang").alias("d_lang"), F.col("source").alias("d_source"), grp.alias("grp")), "qualitygrp")
    dim = dimension(n)
    d = d.join(dim, same(d, dim, "lang", "source"), "left").drop("d_lang", "d_source")
    good = d.where(~F.col("base_failed"))
    # a group that borrows a wider estimate also counts in it: every document stands for its own group and the wider ones
    lean = good.select("lang", "source", "grp", *FEATURES)
    wide = lean.select("*", F.explode(F.array_distinct(F.array("grp", tongue, F.lit("[]")))).alias("g")).drop("lang", "source", "grp").withColumnRenamed("g", "grp")
    small = n.limit(SMALL_GROUPS + 1).count() <= SMALL_GROUPS
    used = n.select("grp").distinct()
    wide = wide.join(F.broadcast(used) if small else used, "grp", "left_semi")
    est = _concentrate(wide, core, steps, small)
    edge = stage(_quantile(_attach(wide, est, small=small).withColumn("d2", _whiten()), ["grp"], F.sqrt("d2"), core, "edge"), "qualityedge")
    model = _attach(est.drop("log_det"), edge, small=small)
    d = _attach(d, stage(model, "qualitymodel"), small=small).withColumn("distance", F.sqrt(_whiten()))
    whole, half = _chi2(reach, len(FEATURES)), _chi2(core, len(FEATURES))
    limit = F.greatest(F.col("edge") / math.sqrt(half), F.lit(1.0)) * math.sqrt(whole)
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= F.coalesce(limit, F.lit(0.0)))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance", limit.alias("limit"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
