import hashlib
import json

import pytest
from pyspark.sql import functions as F

from weirlog.operators import analysis, audit, metrics
from weirlog.sources import readers


def table(spark, templates, ids=None):
    rows = [(i, str(k), t) for i, (k, t) in enumerate(zip(ids or range(1, len(templates) + 1), templates, strict=True))]
    return spark.createDataFrame(rows, "idx long, LineId string, EventTemplate string")


GOLDEN = [
    (["A <NUM>", "B: <*>"], ["a <IP>", "b <*>"], (1, 1, 1, 1)),
    (["A <*>", "A <*>", "B <*>", "B <*>", "C"], ["A <*>", "A <*>", "B <*>", "C", "C"], (0.8, 0.4, 1 / 3, 2 / 3)),
    (["A", "A", "B"], ["X", "X", "Y"], (0, 1, 1, 0)),
    (["A", "A", "B", "B"], ["A", "A", "A", "A"], (0.5, 0, 0, 0)),
    (["A", "A", "B", "B"], ["A", "X", "B", "B"], (0.75, 0.5, 0.4, 0.8)),
]


@pytest.mark.parametrize(("gt", "pred", "want"), GOLDEN)
def test_scores(spark, gt, pred, want):
    r = metrics.evaluate(table(spark, gt), table(spark, pred)).first()
    assert (r["PA"], r["GA"], r["FGA"], r["FTA"]) == pytest.approx(want)


def test_order_does_not_matter(spark):
    t, p = table(spark, ["A", "A", "B"], ["id1", "id2", "id3"]), table(spark, ["B", "A", "A"], ["id3", "id1", "id2"])
    r = metrics.evaluate(t, p).first()
    assert (r["PA"], r["GA"], r["FGA"], r["FTA"]) == (1, 1, 1, 1)
    assert not metrics.order_report(t, p).first()["order_equal"]
    ok = metrics.order_report(table(spark, ["A", "B"]), table(spark, ["A", "B"])).first()
    assert (ok["order_equal"], ok["increasing"]) == (True, True)
    assert not metrics.order_report(table(spark, ["A", "B"], [2, 1]), table(spark, ["A", "B"], [2, 1])).first()["increasing"]


@pytest.mark.parametrize(("a", "b"), [((["A"], [1]), (["A", "B"], [1, 2])), ((["A", "B"], [1, 2]), (["A"], [1])), ((["A", "A"], [1, 1]), (["A", "A"], [1, 1])), (([" "], [1]), (["A"], [1])), (([], []), ([], []))])
def test_bad_rows(spark, a, b):
    with pytest.raises(metrics.AlignmentError):
        metrics.evaluate(table(spark, *a), table(spark, *b))


def test_errors(spark):
    t = spark.createDataFrame([("1", "x1", "A"), ("2", "x2", "A"), ("3", "x3", "B"), ("4", "x4", "C")], "LineId string, Content string, EventTemplate string")
    p = spark.createDataFrame([("1", "x1", "M"), ("2", "x2", "M"), ("3", "x3", "M"), ("4", "x4", "c")], "LineId string, Content string, EventTemplate string")
    j = analysis.joined_errors(t, p)
    assert sorted(tuple(r) for r in analysis.error_pairs(j).collect()) == [("A", "M", 2, "x1"), ("B", "M", 1, "x3")]
    assert analysis.spread_groups(j, "pred_id", "gt_id").first()["different"] == 2
    assert analysis.worst_group(j, "pred_id", "gt_id", "gt_template").first()["templates"] == ["A", "B"]


def test_runs(spark):
    r = spark.createDataFrame([("D1", "Baseline", 0.8, 1.0), ("D1", "X", 0.6, None), ("D2", "Baseline", 0.0, 1.0), ("D2", "X", 0.5, 3.0)], "Dataset string, Variant string, FGA double, FTA double")
    got = {(x["Variant"], x["Dataset"]): (round(x["fall"], 6), round(x["percent"], 6)) for x in analysis.drop_from_baseline(r).collect()}
    assert got == {("X", "D1"): (0.2, 25.0), ("X", "D2"): (-0.5, 0.0)}
    m = analysis.mean_metrics(r.withColumns({"PA": F.lit(1.0), "GA": F.lit(1.0), "EPS": F.lit(2.0)})).first()
    assert (m["with_fta"], m["runs"]) == (3, 4)
    assert spark.range(1).select(analysis.throughput(F.lit(10), F.lit(0.0))).first()[0] == 0
    assert analysis.pivot_metric(r, ["D1", "D3"]).where("Variant = 'X'").first()["D3"] == 0.0


def test_digests(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "o long, v string")
    assert audit.order_digest(df, "v", "o").first()["digest"] == hashlib.sha256(b"a\nb\nc\n").hexdigest()
    same = {audit.block_digest(df.repartition(n), "v", "o", 2).first()["digest"] for n in (1, 3)}
    assert len(same) == 1
    assert audit.stable_hash({"b": 1, "a": [2]}) == hashlib.sha256(b'{"a":[2],"b":1}').hexdigest()[:12]


def test_even_sample(spark):
    got = [r["idx"] for r in audit.even_sample(spark.range(20_000).withColumnRenamed("id", "idx"), 300).orderBy("idx").collect()]
    assert got == sorted({round(i * 9999 / 299) for i in range(300)})


def test_claims(spark):
    text = "The tool demonstrates strong generalization. The tool is not generalizable or out-of-the-box.\nThe tool is generalizable and works\nout-of-the-box here."
    got = {r["claim"] for r in audit.audit_claims(spark.createDataFrame([(text,)], "text string"), "The tool").collect()}
    assert got == {"generalization", "out_of_box"} or got == {"generalization"}
    none = "The tool has limits; results do not generalize."
    assert audit.audit_claims(spark.createDataFrame([(none,)], "text string"), "The tool").count() == 0


def test_run_assessment(spark, tmp_path):
    known = audit.protocol(spark, preprocess_mode="tuned", parameter_mode="uniform", sampling="full")
    assert known["dataset_specific_preprocessing"] and not known["dataset_specific_parameters"] and not known["target_file_used_for_cache_initialization"]
    assert known["evaluation_mode"] == "offline_batch_replay" and len(known["supported_claims"]) == 2 and len(known["unsupported_claims"]) == 4
    for name, run in (("a", {"dataset": "HDFS", "protocol": known}), ("b", {"dataset": "BGL", "config": {"preprocess_mode": "tuned", "parameter_mode": "tuned"}, "sampling_protocol": "global_frequency_top_k_non_online"})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "run_metadata.json").write_text(json.dumps(run))
    one = audit.assess_runs(readers.read_runs(spark, f"{tmp_path}/a"), ["hdfs"]).first()
    assert one["complete_coverage"] and one["record_count"] == 1 and one["datasets"] == ["HDFS"]
    assert one["uses_dataset_specific_preprocessing"] and one["uses_target_file_for_template_generation"]
    assert not one["uses_dataset_specific_parameters"] and not one["uses_complete_file_cache_pretraining"]
    assert one["reason"] == "The evaluated target file is used to generate templates; no held-out-system or chronological split is present."
    both = audit.assess_runs(readers.read_runs(spark, str(tmp_path))).first()
    assert not both["complete_14_dataset_coverage"] and both["datasets"] == ["BGL", "HDFS"]
    assert both["uses_dataset_specific_parameters"] and both["uses_complete_file_cache_pretraining"]
    assert both["claim_verdict"]["dataset_aware_offline_batch_replay"] and not both["claim_verdict"]["zero_shot_transfer"]
    assert "initialize the frequency cache" in both["reason"]


def test_inventory(spark):
    df = table(spark, ["A", "a", "B <x>"], [2, 10, 2])
    r = audit.table_inventory(df).first()
    assert (r["rows"], r["unique_ids"], r["repeated_ids"], r["unique_templates"], r["smallest"]) == (3, 2, 1, 2, ["10", "2"])
    t = spark.createDataFrame([("A", "2"), ("a", "1")], "EventTemplate string, Occurrences string")
    c = audit.occurrence_check(t, 3).first()
    assert (c["occurrences"], c["collisions"], c["complete"]) == (3, 1, True)


def test_id_samples(spark):
    few = metrics.id_samples(table(spark, list("abcde"))).first()
    assert (few["rows"], few["first_ids"], few["last_ids"]) == (5, ["1", "2", "3"], ["1", "2", "3"])
    many = metrics.id_samples(table(spark, list("abcdefg"))).first()
    assert (many["first_ids"], many["last_ids"]) == (["1", "2", "3"], ["5", "6", "7"])
