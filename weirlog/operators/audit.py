"""Inventories, digests, sampling and claim checks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import formats
from ..functions import evaluation_key
from ..plans.shipping import ship

#: Rows whose digests one task chains before chains are chained.
DIGEST_BLOCK = 4_096


def table_inventory(df: DataFrame, *, ids: str = "LineId", event: str | None = None, template: str | None = "EventTemplate") -> DataFrame:
    """One row: rows, different and repeated ids, different events and templates, the three smallest ids as text."""
    exprs = [F.count("*").alias("rows"), F.count_distinct(ids).alias("unique_ids"), (F.count(ids) - F.count_distinct(ids)).alias("repeated_ids")]
    exprs.append(F.count_distinct(event).alias("unique_events") if event else F.lit(None).cast("long").alias("unique_events"))
    exprs.append(F.count_distinct(evaluation_key(F.col(template))).alias("unique_templates") if template else F.lit(None).cast("long").alias("unique_templates"))
    least = df.select(F.col(ids).cast("string").alias("i")).distinct().orderBy("i").limit(3).agg(F.array_sort(F.collect_list("i")).alias("smallest"))
    both = df.agg(*exprs).unionByName(least, allowMissingColumns=True)  # one row each, then one of both
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def occurrence_check(templates: DataFrame, rows: int) -> DataFrame:
    """One row: templates, their occurrences and whether these are the rows, and collisions of normalised templates."""
    key = evaluation_key(F.col("EventTemplate"))
    return templates.agg(
        F.count("*").alias("templates"), F.sum(F.col("Occurrences").cast("long")).alias("occurrences"), F.count_distinct(key).alias("unique_templates"),
        (F.count("*") - F.count_distinct(key)).alias("collisions"), (F.sum(F.col("Occurrences").cast("long")) == rows).alias("complete"),
    )


def order_digest(df: DataFrame, value: str, order: str) -> DataFrame:
    """One row: SHA-256 over all values in order, each followed by a line end; null values are left out.

    Such a digest is sequential by nature. Rows are sorted in ranges over all tasks; one task then reads them range by
    range and holds a batch at a time. block_digest is another digest that needs no such task.
    """
    ship(df.sparkSession)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, rows = hashlib.sha256(), 0
        for batch in batches:
            rows += batch.num_rows
            digest.update("".join(f"{v}\n" for v in batch.column(0).to_pylist() if v is not None).encode())
        yield pa.record_batch([pa.array([digest.hexdigest()]), pa.array([rows], pa.int64())], names=["digest", "rows"])

    values = df.select(F.col(value).cast("string").alias("v"), F.col(order).alias("o")).orderBy("o", "v").select("v")
    whole = values.coalesce(1).mapInArrow(chain, "digest string, rows long")
    return whole.agg(F.coalesce(F.max_by("digest", "rows"), F.sha2(F.lit(""), 256)).alias("digest"), F.coalesce(F.max("rows"), F.lit(0)).cast("long").alias("rows"))


def block_digest(df: DataFrame, value: str, order: str, block: int = DIGEST_BLOCK) -> DataFrame:
    """A two-level digest for tables of any size: blocks of `block` order numbers are digested, then their digests."""
    blocks = df.withColumn("b", F.floor(F.col(order) / block))
    text = lambda o, v: F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(o).alias("o"), F.col(v).cast("string").alias("v")))), lambda s: s["v"]), "\n"), F.lit("\n"))
    each = blocks.groupBy("b").agg(F.sha2(text(order, value), 256).alias("d"), F.count("*").alias("n"))
    return each.agg(F.sha2(text("b", "d"), 256).alias("digest"), F.sum("n").alias("rows"))


def even_sample(df: DataFrame, limit: int, order: str = "idx") -> DataFrame:
    """`limit` rows spread evenly over the first max(limit, min(10000, 40 * limit)) ones, ends included, halves to even."""
    window = max(limit, min(10_000, limit * 40))
    targets = sorted({round(i * (window - 1) / max(limit - 1, 1)) for i in range(limit)})
    return df.where(F.col(order).isin(*targets))


def stable_hash(value: object) -> str:
    """First twelve hex digits of the SHA-256 of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:12]


#: A fixed value: what marks a claim as negated.
NEGATION = r"(?i)\b(?:not|no|never|without|cannot|can't|doesn't|does not|do not|did not|rather than|outside)\b"


def claim_patterns(subject: str) -> dict[str, str]:
    """What an affirmative claim about the subject looks like."""
    s = rf"(?is)\Q{subject}\E[^.\n]{{0,160}}"
    return {
        "out_of_box": s + r"(?:is|works?|operates?|provides?|achieves?|supports?|offers?)[^.\n]{0,80}out[- ]of[- ]the[- ]box",
        "generalization": s + r"(?:generalizes?|generalizable|(?:demonstrates?|proves?|shows?|supports?|achieves?|offers?)[^.\n]{0,80}generaliz(?:ation|ability|able|es?))",
        "zero_shot": s + r"(?:demonstrates?|supports?|achieves?|offers?|enables?)[^.\n]{0,80}zero[- ]shot",
        "online": s + r"(?:achieves?|supports?|provides?|enables?|offers?)[^.\n]{0,80}(?:online parsing|online throughput|online acceleration)",
    }


def audit_claims(texts: DataFrame, subject: str, text: str = "text") -> DataFrame:
    """(claim, found) of every affirmative, not negated claim in the texts."""
    one = lambda name, p: F.transform(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)), lambda m: F.struct(F.lit(name).alias("claim"), F.replace(m, F.lit("\n"), F.lit(" ")).alias("found")))
    every = F.concat(*[one(k, p) for k, p in claim_patterns(subject).items()])
    return texts.select(F.explode(every).alias("c")).select("c.claim", "c.found").where(~F.col("found").rlike(NEGATION))


#: Fixed values of run records: each flag of a run's protocol as a condition on mode, parameters and sampling ...
PROTOCOL_FLAGS = {
    "dataset_specific_preprocessing": "preprocess_mode = 'tuned'",
    "dataset_specific_parameters": "parameter_mode = 'tuned'",
    "target_file_used_for_template_generation": "true",
    "target_file_used_for_cache_initialization": "sampling = 'global_frequency_top_k_non_online'",
    "chronological_split": "false",
    "held_out_target_system": "false",
}
#: ... the claims that runs of this kind support and those that none does, and the fields that sum the flags up.
EVALUATION_MODE = "offline_batch_replay"
SUPPORTED = ("performance_under_the_declared_dataset_aware_recipe", "offline_source_order_replay_throughput")
UNSUPPORTED = ("out_of_the_box_generalization", "zero_shot_transfer", "cross_system_generalization", "chronological_online_parsing")
VERDICT = {"dataset_aware_offline_batch_replay": True, **dict.fromkeys(UNSUPPORTED, False)}
USES = {
    "uses_dataset_specific_preprocessing": "dataset_specific_preprocessing",
    "uses_dataset_specific_parameters": "dataset_specific_parameters",
    "uses_complete_file_cache_pretraining": "target_file_used_for_cache_initialization",
    "uses_target_file_for_template_generation": "target_file_used_for_template_generation",
}
REASON = ("The evaluated target file is used to generate templates", " and initialize the frequency cache", "; no held-out-system or chronological split is present.")


def _flags(settings: DataFrame) -> DataFrame:
    """settings (preprocess_mode, parameter_mode, sampling) with a column for each flag; unknown settings set none."""
    return settings.withColumns({name: F.coalesce(F.expr(rule), F.lit(False)) for name, rule in PROTOCOL_FLAGS.items()})


def protocol(spark: SparkSession, *, preprocess_mode: str, parameter_mode: str, sampling: str) -> dict[str, object]:
    """The protocol that a run's record states."""
    one = spark.range(1).select(F.lit(preprocess_mode).alias("preprocess_mode"), F.lit(parameter_mode).alias("parameter_mode"), F.lit(sampling).alias("sampling"))
    flags = _flags(one).select(*PROTOCOL_FLAGS).first().asDict()
    return {"evaluation_mode": EVALUATION_MODE, **flags, "supported_claims": [*SUPPORTED], "unsupported_claims": [*UNSUPPORTED]}


def assess_runs(runs: DataFrame, expected: Iterable[str] | None = None) -> DataFrame:
    """One row over run records (see read_runs): what data sets they cover, what any of them uses, and what may be claimed.

    A run without a protocol of its own is judged by its settings. Names are compared without regard to case.
    """
    want = sorted(str(x).lower() for x in (expected if expected is not None else formats()))
    derived = _flags(runs.select("dataset", "protocol", F.col("config.preprocess_mode").alias("preprocess_mode"), F.col("config.parameter_mode").alias("parameter_mode"), F.col("sampling_protocol").alias("sampling")))
    said = lambda flag: F.when(F.col("protocol").isNotNull(), F.coalesce(F.col(f"protocol.{flag}"), F.lit(False))).otherwise(F.col(flag))
    names = F.collect_set(F.when(F.col("dataset") != "", F.col("dataset")))
    found = derived.agg(
        F.count("*").alias("record_count"), F.sort_array(names).alias("datasets"),
        *[F.coalesce(F.bool_or(said(flag)), F.lit(False)).alias(name) for name, flag in USES.items()],
    )
    covered = F.sort_array(F.array_distinct(F.transform("datasets", F.lower))) == F.array(*[F.lit(x) for x in want]).cast("array<string>")
    cached = F.when(F.col("uses_complete_file_cache_pretraining"), F.lit(REASON[1])).otherwise(F.lit(""))
    return found.select(
        "record_count", "datasets", covered.alias("complete_14_dataset_coverage" if expected is None else "complete_coverage"), *USES,
        F.struct(*[F.lit(v).alias(k) for k, v in VERDICT.items()]).alias("claim_verdict"), F.concat(F.lit(REASON[0]), cached, F.lit(REASON[2])).alias("reason"),
    )


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of files below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
