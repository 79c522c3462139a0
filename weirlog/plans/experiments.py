"""Runs over data sets: quadrants, ablations, sweeps, manifests and their checks, with records that can be resumed."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from dataclasses import asdict
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import formats
from ..functions import evaluation_key
from ..operators import audit, buckets, metrics
from ..sources import readers, writers
from . import mining

RUNS = {"R010": "U-U", "R011": "T-T", "R012": "U-T", "R013": "T-U"}
KINDS = {"structured_csv": "_full.log_structured.csv", "templates_csv": "_full.log_templates.csv", "raw_log": "_full.log"}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text as one file, by any Hadoop file system: beside its place, then moved there."""
    jvm = spark.sparkContext._jvm
    p, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".partial")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"could not write {path}")


def file_of(root: str, dataset: str, kind: str) -> str:
    return f"{root}/{dataset}/{dataset}{KINDS[kind]}"


def run_dataset(spark: SparkSession, source: str, dataset: str, cell: str, out: str, *, run_id: str = "run", rows_limit: int | None = None, full_parse_rows: int = mining.FULL_PARSE_ROWS, top: int = mining.TOP_STRINGS) -> dict:
    """Mine and score one structured log under a quadrant's settings; writes predictions, and the record last.

    A row-limited run takes an even sample and parses it in full. The record holds the settings' hash, so an earlier
    record with the same hash is a finished run (see finished).
    """
    s = mining.quadrant(dataset, cell)
    config = {"quadrant": cell, "dataset": dataset, "preprocess_mode": "tuned" if cell[0] == "T" else "uniform", "parameter_mode": "tuned" if cell[-1] == "T" else "uniform", "params": asdict(s.params) | {"top_k": top}, "rows_limit": rows_limit, "cache_threshold": full_parse_rows}
    clock = {}

    def timed(name: str, since: float) -> float:
        now = time.perf_counter()
        clock[name] = now - since
        return now

    t = time.perf_counter()
    rows = readers.read_structured(spark, source)
    if rows_limit is not None:
        rows = audit.even_sample(rows, rows_limit)
    rows = mining.stage(mining.masked_rows(rows, s.format), "rows")
    n = rows.count()
    if not n:
        raise ValueError(f"no rows for {dataset}")
    digest = audit.block_digest(rows, "masked", "idx").first()["digest"]
    t = timed("load_and_mask", t)
    model = mining.fit(rows, s, full_parse_rows=full_parse_rows if rows_limit is None else max(n, 1), top=top)
    t = timed("fit", t)
    parsed = mining.stage(mining.transform(model, rows), "parsed")
    path = f"{out}/{dataset.lower()}_{cell.replace('-', '')}_{audit.stable_hash(config)}_predictions.csv"
    writers.write_predictions(parsed, path)
    t = timed("inference", t)
    aligned = metrics.align(rows.select("LineId", "EventTemplate"), parsed.select("LineId", F.col("event_template").alias("EventTemplate")))
    score = metrics.scores(metrics.contingency(aligned)).first().asDict()
    timed("evaluation", t)
    clock["total"] = sum(clock.values())
    sampling = "full_parse" if model.full else "global_frequency_top_k_non_online"
    counts = parsed.groupBy("source").count().collect()
    record = {
        "run_id": run_id, "dataset": dataset, "quadrant": cell, "config_hash": audit.stable_hash(config), "config": config, "rows": n, "preprocessed_sha256": digest, "sampling_protocol": sampling,
        "protocol": audit.protocol(spark, preprocess_mode=config["preprocess_mode"], parameter_mode=config["parameter_mode"], sampling=sampling),
        "bucket_count": bucket_statistics(rows, s).first()["buckets"], "cluster_count": model.assigned.select("cluster_id").distinct().count(), "template_count": model.events.count(),
        "cache": {r["source"]: r["count"] for r in counts}, "timing_seconds": clock, "prediction_path": path, "metrics": {**score, "alignment": {"missing_line_ids": [], "extra_line_ids": []}}, "created_at": datetime.now(UTC).isoformat(),
    }
    put_text(spark, f"{out}/run_metadata.json", json.dumps(record, indent=2, ensure_ascii=False))
    return record


def finished(spark: SparkSession, root: str) -> set[tuple[str, str]]:
    """(run, data set) with a record below root."""
    if not exists(spark, root):
        return set()
    return {(r["run_id"], r["dataset"]) for r in readers.read_runs(spark, root).select("run_id", "dataset").collect()}


def run_quadrant(spark: SparkSession, root: str, run_id: str, datasets: Iterable[str], out: str, **options) -> DataFrame:
    """Run a quadrant over data sets that have no record yet, and return the summary of all of its records."""
    if run_id not in RUNS:
        raise ValueError(f"unknown run {run_id}; known are {sorted(RUNS)}")
    done = finished(spark, f"{out}/{run_id}")
    for d in datasets:
        if (run_id, d) not in done:
            run_dataset(spark, file_of(root, d, "structured_csv"), d, RUNS[run_id], f"{out}/{run_id}/{d}", run_id=run_id, **options)
    return writers.run_summary(readers.read_runs(spark, f"{out}/{run_id}"))


def read_records(spark: SparkSession, root: str) -> list[dict]:
    """Whole run records; there is one for each run, so their number is small."""
    rows = spark.read.options(recursiveFileLookup=True, pathGlobFilter="run_metadata.json").text(root, wholetext=True).collect()
    return [json.loads(r["value"]) for r in rows]


def validate_quadrants(records: Iterable[dict], datasets: Iterable[str]) -> dict[str, bool]:
    """Whether quadrants differ in the factor that they should differ in, and in nothing else."""
    by = {(r["dataset"], r["quadrant"]): r for r in records}
    checks: dict[str, bool] = {}
    for d in datasets:
        have = {c: by.get((d, c)) for c in RUNS.values()}
        for c, r in have.items():
            checks[f"{d}_{c}_exists"] = r is not None
        if None in have.values():
            continue
        checks[f"{d}_UU_UT_same_preprocess"] = have["U-U"]["preprocessed_sha256"] == have["U-T"]["preprocessed_sha256"]
        checks[f"{d}_TU_TT_same_preprocess"] = have["T-U"]["preprocessed_sha256"] == have["T-T"]["preprocessed_sha256"]
        checks[f"{d}_UU_TU_same_params"] = have["U-U"]["config"]["params"] == have["T-U"]["config"]["params"]
        checks[f"{d}_UT_TT_same_params"] = have["U-T"]["config"]["params"] == have["T-T"]["config"]["params"]
        checks[f"{d}_all_line_counts_equal"] = len({r["rows"] for r in have.values()}) == 1
        checks[f"{d}_all_predictions_aligned"] = all(not r["metrics"]["alignment"][k] for r in have.values() for k in ("missing_line_ids", "extra_line_ids"))
    checks["all_checks_pass"] = bool(checks) and all(checks.values())
    return checks


def manifest(spark: SparkSession, root: str, datasets: Iterable[str]) -> list[dict]:
    """A record of every expected file: size, digest, rows and identifiers; missing ones are marked."""
    out = []
    for d in datasets:
        for kind in KINDS:
            path = file_of(root, d, kind)
            if not exists(spark, path):
                out.append({"dataset": d, "kind": kind, "path": path, "missing": True})
                continue
            size = audit.file_inventory(spark, path).first()
            record = {"dataset": d, "kind": kind, "path": path, "bytes": size["bytes"], "sha256": size["sha256"], "missing": False}
            if kind == "raw_log":
                record["rows"] = readers.raw_line_count(spark, path)
            elif kind == "structured_csv":
                r = audit.table_inventory(readers.read_structured(spark, path)).first()
                record |= {"rows": r["rows"], "unique_line_ids": r["unique_ids"], "duplicate_line_ids": r["repeated_ids"], "unique_templates": r["unique_templates"], "smallest_line_ids": r["smallest"]}
            else:
                record["rows"] = readers.read_templates(spark, path).count()
            out.append(record)
    return out


def validate_manifest(spark: SparkSession, root: str, records: list[dict], datasets: Iterable[str]) -> dict[str, bool]:
    """Files present, line ids unique, and rows equal across structured log, raw log and template occurrences."""
    names = list(datasets)
    by = {(r["dataset"], r["kind"]): r for r in records}
    checks = {"record_count": len(records) == 3 * len(names), "no_missing_files": not any(r["missing"] for r in records), "no_duplicate_structured_line_ids": not any(r.get("duplicate_line_ids") for r in records)}
    for d in names:
        if any(by[(d, k)]["missing"] for k in KINDS):
            continue
        n = by[(d, "structured_csv")]["rows"]
        checks[f"{d}_raw_rows_equal_structured"] = by[(d, "raw_log")]["rows"] == n
        checks[f"{d}_occurrences_equal_structured"] = bool(audit.occurrence_check(readers.read_templates(spark, file_of(root, d, "templates_csv")), n).first()["complete"])
    checks["all_core_checks_pass"] = all(checks.values())
    return checks


def score_rows(parsed: DataFrame, name: str, seconds: float, truth: str = "EventTemplate") -> DataFrame:
    """One row of a metrics summary."""
    a = parsed.select(F.col("LineId").alias("id"), evaluation_key(F.col(truth)).alias("gt"), evaluation_key(F.col("event_template")).alias("pred"))
    s = metrics.scores(metrics.contingency(a))
    eps = F.round(F.when(F.lit(seconds) > 0, F.col("rows") / F.lit(seconds)).otherwise(0.0), 2)
    return s.select(F.lit(name).alias("Dataset"), F.col("rows").alias("TotalLogs"), *[F.col(x.lower()).alias(x) for x in ("GT_Clusters", "Pred_Clusters", "Matched_Clusters", "Matched_Templates")], "PA", "GA", "FGA", "PTA", "RTA", "FTA", F.lit(seconds).alias("Runtime"), eps.alias("EPS"))


def benchmark(spark: SparkSession, root: str, out: str, datasets: Iterable[str] | None = None) -> DataFrame:
    """Parse and score all data sets that root has; each one's row replaces its earlier one in the summary table."""
    for d in datasets or formats():
        path = file_of(root, d, "structured_csv")
        if not exists(spark, path):
            print(f"{d}: no file, skipped")
            continue
        s = mining.settings(d)
        rows = mining.stage(mining.masked_rows(readers.read_structured(spark, path), s.format), "rows")
        began = time.perf_counter()
        parsed = mining.stage(mining.transform(mining.fit(rows, s), rows), "parsed")
        seconds = time.perf_counter() - began
        writers.write_predictions(parsed, f"{out}/{d}_predictions.csv", by_line=True)
        writers.upsert_table(spark, f"{out}/summary", score_rows(parsed, d, seconds), ["Dataset"])
    return spark.read.parquet(f"{out}/summary")


def ablation(spark: SparkSession, rows_of: dict[str, DataFrame], variants: Iterable[str] = mining.VARIANTS) -> DataFrame:
    """(Variant, Dataset, PA, ..., FTA, Runtime, EPS) of variants over tables (idx, LineId, Content, EventTemplate)."""
    unknown = set(variants) - set(mining.VARIANTS) - {"Default"}
    if unknown:
        raise ValueError(f"unknown variants {sorted(unknown)}")
    out = None
    for d, df in rows_of.items():
        for v in variants:
            s = mining.variant(v, d)
            rows = mining.stage(mining.masked_rows(df, s.format), "masked")
            began = time.perf_counter()
            parsed = mining.stage(mining.transform(mining.fit(rows, s), rows), "parsed")
            r = score_rows(parsed, d, time.perf_counter() - began).withColumn("Variant", F.lit(v))
            out = r if out is None else out.unionByName(r)
    return out


def bucket_statistics(rows: DataFrame, s: mining.Settings) -> DataFrame:
    """One row: buckets and the largest one's messages under the settings."""
    items = buckets.items(rows)
    places = buckets.anchors(buckets.positional_entropy(items, s.params.max_check_positions), s.params.entropy_threshold)
    return buckets.bucket_sizes(buckets.with_bucket(items, places)).agg(F.count("*").alias("buckets"), F.max("n").alias("largest"))
