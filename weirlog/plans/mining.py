"""Fit and transform: from masked messages to a model, and from messages to events."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import UNIFORM, Params, params, resolve
from ..functions import evaluation_key, mask, strip_text, template_key
from ..operators import buckets, clustering, events, metrics, patterns
from ..operators import replay as replays
from .staging import dimension, stage

#: Larger inputs are trained on their most frequent different strings and replayed.
FULL_PARSE_ROWS, TOP_STRINGS = 50_000, 8_000


@dataclass(frozen=True)
class Settings:
    """One way to mine: bucketing, cutoff, folding and lookup are chosen independently."""

    format: str = "loghub"
    params: Params = Params()
    bucketing: str = "anchor"  # or "none"
    similarity: float | None = None  # None: elbow cutoff; else a fixed one
    fold: str = "align"  # or "pattern"
    lookup: str = "nearest"  # or "prefix", "canonical"
    event_key: Callable[[Column], Column] = template_key
    #: Whether a large input's training strings are bucketed like a small one's rows.
    bucket_training: bool = True


def settings(name: str, **changes) -> Settings:
    return replace(Settings(resolve(name), params(name)), **changes)


#: Parameters that the variants use where they differ from a format's own (entropy limit, positions).
_VARIANT_PARAMS = {"hdfs": (1.0, 15), "mac": (2.5, 12)}


def variant(name: str, dataset: str) -> Settings:
    """The settings of a named ablation variant."""
    base = settings(dataset)
    fixed = {"FixedThresholdLow": 0.3, "FixedThreshold04": 0.4, "FixedThreshold05": 0.5, "FixedThreshold06": 0.6, "FixedThresholdHigh": 0.7}
    if name == "Default":
        return base
    if name == "NoBucket":
        return replace(base, bucketing="none", bucket_training=False)
    if name in fixed:
        theta, positions = _VARIANT_PARAMS.get(dataset.strip().lower(), (1.5, 12))
        return replace(base, similarity=fixed[name], params=replace(base.params, entropy_threshold=theta, max_check_positions=positions), bucket_training=False)
    if name in ("NoSequenceAlign", "TreeCache"):
        own = replace(base.params, entropy_threshold=1.5, max_check_positions=12) if dataset.strip().lower() == "hadoop" else base.params
        if name == "TreeCache":
            return replace(base, lookup="prefix", params=own, bucket_training=False)
        return replace(base, fold="pattern", params=own)
    raise ValueError(f"unknown variant {name}")


VARIANTS = ("NoBucket", "FixedThresholdLow", "FixedThreshold04", "FixedThreshold05", "FixedThreshold06", "FixedThresholdHigh", "NoSequenceAlign", "TreeCache")


def quadrant(dataset: str, cell: str) -> Settings:
    """U-U, U-T, T-U or T-T: uniform or tuned masking, then uniform or tuned parameters."""
    first, _, second = cell.partition("-")
    if {first, second} - {"U", "T"} or not second:
        raise ValueError(f"unknown quadrant {cell}")
    return Settings(resolve(dataset) if first == "T" else "loghub", params(dataset) if second == "T" else UNIFORM, event_key=evaluation_key, lookup="canonical")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: masking costs more than moving a small input once.

    A large input has more partitions than that and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and df.rdd.getNumPartitions() < cores else df


def masked_rows(df: DataFrame, format: str | Callable[[Column], Column], content: str = "Content", order: str = "idx") -> DataFrame:
    """df with idx and masked; contents are stripped, then masked, in one projection.

    format is a format's name or a masking function of one's own, which gives one value for each row by construction.
    """
    text = strip_text(F.coalesce(F.col(content), F.lit("")))
    return spread(df).withColumn("idx", F.col(order).cast("long")).withColumn("masked", format(text) if callable(format) else mask(text, format))


@dataclass(frozen=True)
class Model:
    """Staged tables: strings (masked, event_id, event_template, cluster_id) and events (event_ord, event_id, event_template)."""

    settings: Settings
    assigned: DataFrame
    strings: DataFrame
    events: DataFrame
    full: bool
    #: Rows that strings and events have at most.
    bound: int


def fit_items(items: DataFrame, s: Settings, bucketed: bool = True) -> tuple[DataFrame, DataFrame]:
    """((idx, masked, cluster_id, event_id, event_template), (event_ord, event_id, event_template)) of items (idx, masked)."""
    tok = stage(buckets.items(items), "items")
    if s.bucketing == "anchor" and bucketed:
        places = buckets.anchors(buckets.positional_entropy(tok, s.params.max_check_positions), s.params.entropy_threshold)
        tok = buckets.with_bucket(tok, places)
    else:
        tok = tok.withColumn("bucket", F.lit("ALL"))
    mined = stage(clustering.mine_clusters(tok, clustering.Mining(s.params, s.similarity, s.fold)), "mined")
    named = clustering.number_clusters(mined)
    if s.fold == "pattern":
        t = patterns.mine_patterns(tok.join(named.select(F.col("idx").alias("i"), "cluster_id"), F.col("idx") == F.col("i")).select("idx", "tokens", "cluster_id"))
        ids = stage(events.number_events(t, s.event_key), "events").withColumnRenamed("cluster_id", "c")
        named = named.select("idx", "cluster_id").join(dimension(ids), F.col("cluster_id") == F.col("c")).drop("c")
    else:
        named = events.with_events(named, s.event_key)
    named = named.join(tok.select(F.col("idx").alias("i"), "masked"), F.col("idx") == F.col("i"))
    named = stage(named.select("idx", "masked", "cluster_id", "event_ord", "event_id", "event_template"), "assigned")
    return named.drop("event_ord"), named.select("event_ord", "event_id", "event_template").distinct()


def fit(masked: DataFrame, s: Settings, *, full_parse_rows: int = FULL_PARSE_ROWS, top: int = TOP_STRINGS) -> Model:
    """Mine a model: from all rows if they are few, else from the `top` most frequent different strings."""
    rows = masked.select("idx", "masked")
    full = rows.limit(full_parse_rows + 1).count() <= full_parse_rows
    items = rows if full else buckets.top_strings(rows, top).select("idx", "masked")
    assigned, ev = fit_items(items, s, bucketed=full or s.bucket_training)
    strings = assigned.groupBy("masked").agg(F.max(F.struct("cluster_id", "event_id", "event_template")).alias("last")).select("masked", "last.*")
    return Model(s, assigned, strings, ev, full, full_parse_rows if full else top)


def transform(model: Model, masked: DataFrame) -> DataFrame:
    """masked with event_id, event_template and source. A full parse gives its rows their own clusters' events."""
    if model.full and model.settings.lookup != "canonical":
        own = model.assigned.select(F.col("idx").alias("i"), "event_id", "event_template")
        return masked.join(own, F.col("idx") == F.col("i")).drop("i").select(*masked.columns, "event_id", F.lit("cluster").alias("source"), "event_template")
    if model.settings.lookup == "prefix":
        return replays.replay_prefix(masked, model.strings, model.events, bound=model.bound)
    if model.settings.lookup == "canonical":
        return replays.replay_canonical(masked, model.strings, model.events, bound=model.bound)
    return replays.replay(masked, model.strings, model.events, bound=model.bound)


def parse(df: DataFrame, dataset: str = "loghub", *, content: str = "Content", order: str = "idx", **changes) -> DataFrame:
    """Mask, fit and transform: df with masked, event_id and event_template."""
    s = settings(dataset, **changes)
    rows = stage(masked_rows(df, s.format, content, order), "masked")  # read by fit and transform: mask once
    return transform(fit(rows, s), rows)


def parse_lines(spark: SparkSession, lines: Iterable[str], dataset: str = "loghub", **changes) -> DataFrame:
    """Parse messages in memory: (idx, Content, masked, event_id, event_template)."""
    return parse(spark.createDataFrame(list(enumerate(lines)), "idx long, Content string"), dataset, **changes)


def done_thresholds(results: DataFrame, dataset: str) -> list[float]:
    """Thresholds of a sweep's results that count as done: those with an FTA."""
    done = results.where((F.col("Dataset") == dataset) & F.col("FTA").isNotNull()).select(F.col("EntropyThreshold").cast("double").alias("t")).distinct()
    return sorted(r["t"] for r in done.collect())


def sweep(df: DataFrame, dataset: str, thresholds: list[float], truth: str, done: list[float] = (), *, content: str = "Content", order: str = "idx", id_col: str = "LineId") -> DataFrame:
    """Scores by entropy threshold, (threshold, PA, GA, ...); thresholds already done are skipped."""
    base = settings(dataset)
    rows = stage(masked_rows(df, base.format, content, order), "masked")
    out = None
    for t in thresholds:
        if t in done:
            continue
        s = replace(base, params=replace(base.params, entropy_threshold=t))
        got = transform(fit(rows, s), rows)
        a = got.select(F.col(id_col).alias("id"), evaluation_key(F.col(truth)).alias("gt"), evaluation_key(F.col("event_template")).alias("pred"))
        row = metrics.scores(metrics.contingency(a)).withColumn("threshold", F.lit(float(t)))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("nothing left to do")
    return out
