"""Command line: parse and evaluate logs, run quadrants and benchmarks, check manifests."""

from __future__ import annotations

import argparse
import json
import os
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weirlog", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("parse", help="mine a structured log and write predictions")
    c.add_argument("source")
    c.add_argument("out")
    c.add_argument("--dataset", default="loghub")
    c = sub.add_parser("evaluate", help="score predictions against ground truth")
    c.add_argument("truth")
    c.add_argument("predicted")
    c = sub.add_parser("run", help="run a quadrant over data sets")
    c.add_argument("run_id")
    c.add_argument("root")
    c.add_argument("out")
    c.add_argument("--datasets", nargs="+", required=True)
    c.add_argument("--rows", type=int)
    c = sub.add_parser("benchmark", help="parse and score all data sets below a folder")
    c.add_argument("root")
    c.add_argument("out")
    c.add_argument("--datasets", nargs="+")
    c = sub.add_parser("manifest", help="inventory and check the files of data sets")
    c.add_argument("root")
    c.add_argument("--datasets", nargs="+", required=True)
    a = p.parse_args(argv)

    from pyspark.sql import SparkSession

    from .operators import metrics
    from .plans import experiments, mining
    from .sources import readers, writers

    spark = SparkSession.builder.appName("weirlog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel(os.environ.get("WEIRLOG_LOG", "ERROR"))
    if a.command == "parse":
        writers.write_predictions(mining.parse(readers.read_structured(spark, a.source), a.dataset), a.out)
    elif a.command == "evaluate":
        try:
            score = metrics.evaluate(readers.read_pairs(spark, a.truth), readers.read_pairs(spark, a.predicted)).first()
        except metrics.AlignmentError as e:
            print(e, file=sys.stderr)
            return 1
        print(json.dumps(score.asDict()))
    elif a.command == "run":
        experiments.run_quadrant(spark, a.root, a.run_id, a.datasets, a.out, rows_limit=a.rows).show(truncate=False)
    elif a.command == "benchmark":
        experiments.benchmark(spark, a.root, a.out, a.datasets).show(truncate=False)
    else:
        records = experiments.manifest(spark, a.root, a.datasets)
        checks = experiments.validate_manifest(spark, a.root, records, a.datasets)
        print(json.dumps({"files": records, "checks": checks}, indent=1, default=str))
        return 0 if checks["all_core_checks_pass"] else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
