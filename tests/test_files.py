import csv
import json
import time

from weirlog.operators import audit
from weirlog.plans import mining
from weirlog.sources import readers, writers
from weirlog.streaming import dedupe_unseen, replay_stream


def test_structured_csv(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text('﻿LineId,Time,Content,EventTemplate\n1,x,"  a ""quoted"" b\nnext ",A\n2,x,NA,\n3,x,,"B, b"\n', encoding="utf-8")
    rows = readers.read_structured(spark, str(path)).orderBy("idx").collect()
    assert [(r["idx"], r["LineId"], r["Content"], r["EventTemplate"]) for r in rows] == [(0, "1", 'a "quoted" b\nnext', "A"), (1, "2", "NA", ""), (2, "3", "", "B, b")]
    try:
        readers.read_structured(spark, str(path), event_id=True)
    except ValueError as e:
        assert "EventId" in str(e)
    else:
        raise AssertionError("a missing column was not noticed")


def test_raw_text(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\ntwo \xff\nthree")
    assert readers.raw_line_count(spark, str(tmp_path / "a.log")) == 3
    assert [r["Content"][:3] for r in readers.read_raw(spark, str(tmp_path / "a.log")).orderBy("idx").collect()] == ["one", "two", "thr"]
    assert audit.file_inventory(spark, str(tmp_path), "*.log").first()["bytes"] == 15


def test_predictions_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "10", 'x "1"'), (1, "9", "x 2")], "idx long, LineId string, Content string")
    parsed = mining.parse(df, "loghub")
    writers.write_predictions(parsed, str(tmp_path / "p"), by_line=True)
    back = readers.read_csv(spark, str(tmp_path / "p"), writers.COLUMNS).collect()
    assert sorted(r["LineId"] for r in back) == ["10", "9"]
    assert {r["Content"] for r in back} == {'x "1"', "x 2"}


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "metrics")
    old = spark.createDataFrame([("old", 0.5), ("new", 0.1)], "Dataset string, PA double")
    writers.upsert_table(spark, path, old, ["Dataset"])
    new = spark.createDataFrame([("new", 0.9, 1.0)], "Dataset string, PA double, FTA double")
    for _ in range(2):
        writers.upsert_table(spark, path, new, ["Dataset"])
    rows = {r["Dataset"]: (r["PA"], r["FTA"]) for r in spark.read.parquet(path).collect()}
    assert rows == {"old": (0.5, None), "new": (0.9, 1.0)}


def test_run_records(spark, tmp_path):
    for k in ("b", "a"):
        (tmp_path / k).mkdir()
        (tmp_path / k / "run_metadata.json").write_text(json.dumps({"run_id": k, "dataset": "HDFS", "rows": 3, "metrics": {"PA": 0.5}, "timing_seconds": {"total": 2.5}}, indent=1))
    runs = readers.read_runs(spark, str(tmp_path))
    assert [r["run_id"] for r in runs.collect()] == ["a", "b"]
    assert [(r["PA"], r["total_seconds"]) for r in writers.run_summary(runs).collect()] == [(0.5, 2.5)] * 2


def test_result_files(spark, tmp_path):
    (tmp_path / "ablation_x_results.csv").write_text("﻿Dataset,PA,FGA\nHDFS_NoBucket,0.5,0.25\n", encoding="utf-8")
    r = readers.read_variant_results(spark, str(tmp_path)).first()
    assert (r["Variant"], r["DatasetName"], r["FGA"], r["FTA"]) == ("NoBucket", "HDFS", 0.25, None)


def test_stream(spark, tmp_path):
    train = spark.createDataFrame([(i, f"open file {i}") for i in range(5)] + [(9, "stop now")], "idx long, Content string")
    s = mining.settings("loghub")
    rows = mining.masked_rows(train, "loghub")
    model = mining.fit(rows, s)
    spark.createDataFrame([("open file 77",), ("who knows 5",), ("who knows 6",), ("stop now",)], "Content string").coalesce(1).write.json(str(tmp_path / "in"))
    lines = spark.readStream.schema("Content string").json(str(tmp_path / "in"))
    replayed = replay_stream(lines, model)
    q = replayed.writeStream.format("memory").queryName("weirlog_replay").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r["Content"]: r["event_id"] for r in spark.table("weirlog_replay").collect()}
    assert got["who knows 5"] == "E99"
    assert got["open file 77"] != "E99"
    q = dedupe_unseen(replay_stream(lines, model)).writeStream.format("memory").queryName("weirlog_unseen").outputMode("append").start()
    until = time.time() + 60  # state that can time out keeps triggering, so the query does not end by itself
    while time.time() < until and not spark.table("weirlog_unseen").count():
        time.sleep(0.5)
    q.stop()
    assert [(r["masked"], r["seen"]) for r in spark.table("weirlog_unseen").collect()] == [("who knows <*>", 2)]


def test_single_line_records_read_alike(spark, tmp_path):
    rows = [(str(i), f'say "{i}", NA,' if i % 3 else "", f"say <*> {i}") for i in range(50)]
    path = str(tmp_path / "t.csv")
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["LineId", "Content", "EventTemplate"])
        w.writerows(rows)
    one, many = (readers.read_structured(spark, path, multi_line=m).orderBy("idx").collect() for m in (True, False))
    assert one == many
    assert [r["LineId"] for r in one] == [r[0] for r in rows]
