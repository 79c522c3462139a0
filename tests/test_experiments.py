import csv
import json

import pytest

from weirlog.__main__ import main
from weirlog.plans import experiments, mining


@pytest.fixture
def root(tmp_path):
    """A small data set in the layout of structured log, templates and raw log."""
    for name in ("HDFS", "Spark"):
        folder = tmp_path / "data" / name
        folder.mkdir(parents=True)
        rows = [(i + 1, f"open file {i} by ann" if i % 3 else f"shut down node-{i}", "open file <*> by ann" if i % 3 else "shut down node-<*>") for i in range(60)]
        with (folder / f"{name}_full.log_structured.csv").open("w", newline="") as f:
            csv.writer(f).writerows([("LineId", "Content", "EventTemplate"), *rows])
        with (folder / f"{name}_full.log_templates.csv").open("w", newline="") as f:
            csv.writer(f).writerows([("EventTemplate", "Occurrences"), ("open file <*> by ann", 40), ("shut down node-<*>", 20)])
        (folder / f"{name}_full.log").write_text("\n".join(r[1] for r in rows) + "\n")
    return str(tmp_path / "data")


def test_quadrants_resume_and_validate(spark, root, tmp_path):
    out = str(tmp_path / "out")
    for run_id in experiments.RUNS:
        summary = experiments.run_quadrant(spark, root, run_id, ["HDFS"], out)
        assert summary.count() == 1
    record = json.loads((tmp_path / "out" / "R011" / "HDFS" / "run_metadata.json").read_text())
    assert record["rows"] == 60
    assert record["metrics"]["GA"] == 1.0
    before = record["created_at"]
    experiments.run_quadrant(spark, root, "R011", ["HDFS"], out)
    assert json.loads((tmp_path / "out" / "R011" / "HDFS" / "run_metadata.json").read_text())["created_at"] == before
    records = experiments.read_records(spark, out)
    checks = experiments.validate_quadrants(records, ["HDFS"])
    assert checks["all_checks_pass"], checks
    assert not experiments.validate_quadrants(records[:3], ["HDFS"])["all_checks_pass"]
    with pytest.raises(ValueError):
        experiments.run_quadrant(spark, root, "R999", ["HDFS"], out)


def test_row_limit_is_an_even_sample(spark, root, tmp_path):
    r = experiments.run_dataset(spark, experiments.file_of(root, "HDFS", "structured_csv"), "HDFS", "U-U", str(tmp_path / "x"), rows_limit=10)
    assert r["rows"] < 10 or r["rows"] == 10
    assert r["sampling_protocol"] == "full_parse"


def test_manifest(spark, root):
    records = experiments.manifest(spark, root, ["HDFS", "Spark"])
    checks = experiments.validate_manifest(spark, root, records, ["HDFS", "Spark"])
    assert checks["all_core_checks_pass"], checks
    lost = experiments.manifest(spark, root, ["Mac"])
    assert all(r["missing"] for r in lost)
    assert not experiments.validate_manifest(spark, root, lost, ["Mac"])["no_missing_files"]


def test_benchmark_and_ablation(spark, root, tmp_path):
    out = str(tmp_path / "bench")
    for _ in range(2):
        summary = experiments.benchmark(spark, root, out, ["HDFS", "None"])
    assert [(r["Dataset"], r["TotalLogs"], r["GA"]) for r in summary.collect()] == [("HDFS", 60, 1.0)]
    rows = spark.createDataFrame([(i, str(i), f"open {i}" if i % 2 else f"shut it {i} now", "open <*>" if i % 2 else "shut it <*> now") for i in range(20)], "idx long, LineId string, Content string, EventTemplate string")
    got = experiments.ablation(spark, {"Spark": rows}, ["NoBucket", "NoSequenceAlign"]).collect()
    assert {r["Variant"] for r in got} == {"NoBucket", "NoSequenceAlign"}
    assert all(r["GA"] == 1.0 for r in got if r["Variant"] == "NoSequenceAlign")
    with pytest.raises(ValueError):
        experiments.ablation(spark, {"Spark": rows}, ["Other"])
    s = mining.settings("spark")
    assert experiments.bucket_statistics(mining.masked_rows(rows, "spark"), s).first()["buckets"] >= 1


def test_command_line(spark, root, tmp_path, capsys):
    source = experiments.file_of(root, "HDFS", "structured_csv")
    assert main(["parse", source, str(tmp_path / "p"), "--dataset", "HDFS"]) == 0
    assert main(["evaluate", source, str(tmp_path / "p")]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["GA"] == 1.0
    assert main(["evaluate", source, experiments.file_of(root, "HDFS", "structured_csv").replace("HDFS_full.log_structured", "HDFS_full.log_structured")]) == 0
    assert main(["manifest", root, "--datasets", "HDFS"]) == 0
