import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirlog import config, functions
from weirlog.config import Params, Rule
from weirlog.config.loading import load_params, load_rules


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


GOLDEN = [
    ("loghub", "proxy.example.com:8080 12:34 10 MB (IPv6)", "<*> <*> <*> <*>"),
    ("zookeeper", "shutting down 123", "Shutting down <*>"),
    ("mac", "Wake reason: EC.DarkPME 123", "Wake reason: <*>"),
    ("linux", "user alice (uid=42) value=abc ()", "user <*> <*> value=<*> (<*>)"),
    ("no such format", "server.example:9000", "<*>"),
    ("hdfs", "Received block blk_123 from 10.0.0.1:50010", "Received block <*> from <*>"),
]


@pytest.mark.parametrize(("name", "line", "masked"), GOLDEN)
def test_masks(spark, name, line, masked):
    assert one(spark, lambda c: functions.mask(c, name), line) == masked


def test_formats():
    assert len(config.formats()) == 14
    assert sum(map(len, config.RULES.values())) == 187
    assert config.resolve(" Proxifier ") == "loghub"
    assert config.params("HDFS") == Params(1.0, 15, 0.85)
    assert config.params("unheard of") == Params()


def python_mask(name, line):
    for r in config.RULES[name]:
        line = re.sub(r.pattern, r.replacement, line, flags=sum((getattr(re, f) for f in r.flags), re.NOFLAG))
    return line.strip()


LINES = [
    "user bob by (uid=0) from 10.0.0.1 port 22 é5 5é ٣ 0x1f [7] /var/log\x1cx \xa0 end\nnext=1", "maps to host.x, but for bob from 9 user al by z",
    "program /usr/bin/a exited Function=main(1)\nline", "5 (n.leader) 7 (my state) Expiring session 0x1, timeout of 10ms", "xY1: from=<a@b>, size=12 data source name foo bar",
    "'q' '  spaced ' BP-1.2-3:blk_1_2 12 KB 5ms task 0.1 in stage 2.3 $1 \\1", "", "   ", "IPV4 ipv6 1.5 aa:bb:cc:dd:ee:ff",
]


@pytest.mark.parametrize("name", config.formats())
def test_masks_as_python_does(spark, name):
    rows = spark.createDataFrame(list(enumerate(LINES)), "i int, v string").select("i", functions.mask(F.col("v"), name).alias("x")).collect()
    assert {r["i"]: r["x"] for r in rows} == {i: python_mask(name, v) for i, v in enumerate(LINES)}


@given(st.lists(st.text(alphabet="ab1/ \t\x1c\x85\xa0 <*>=.", max_size=12), min_size=1, max_size=20))
@settings(max_examples=15, deadline=None)
def test_tokens_and_keys(spark, values):
    def canonical(v):
        return " ".join("<*>" if "/" in t else re.sub(r"\d+", "<*>", t) for t in v.split())

    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select("v", functions.tokens(F.col("v")).alias("t"), functions.strip_text(F.col("v")).alias("s"), functions.canonical_key(F.col("v")).alias("c")).collect()
    for r in rows:
        assert (r["t"], r["s"], r["c"]) == (r["v"].split(), r["v"].strip(), canonical(r["v"]))


def test_keys(spark):
    assert one(spark, functions.template_key, "Task [<*>]: Done!") == "task*done"
    assert one(spark, functions.evaluation_key, "A <NUM> <a\nb> c") == "a*abc"
    assert one(spark, functions.evaluation_key, None) == ""
    assert one(spark, functions.canonical_key, "a/b x12y 7") == "<*> x<*>y <*>"


def test_semantic_types(spark):
    want = {"12": "number", "-1.5": "number", "1.2.3.4": "ip", "/a-b.c": "path", "/x,y": "path", "C:\\a": "path", "http://x": "url", "0xfF": "hex", "2020-01-02": "date", "10:11:12": "time", "abc": "literal"}
    assert {k: one(spark, functions.semantic_type, k) for k in want} == want


def test_bucket_keys(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(functions.bucket_key(F.col("t"), [0, 1, 5])).collect()] == ["P0:a_P1:b", "NO_ANCHOR"]


def test_rule_files(tmp_path):
    good = {"schema_version": 1, "default_dataset": "demo", "aliases": {"d": "demo"}, "datasets": {"demo": {"strip": True, "rules": [{"pattern": "x+", "replacement": "<*>", "flags": ["IGNORECASE"]}]}}}
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(good))
    book = load_rules(str(path))
    assert book.resolve("D") == "demo"
    assert book.rules["demo"] == (Rule("x+", "<*>", ("IGNORECASE",), "rule_01"),)
    good["datasets"]["demo"]["rules"][0]["pattern"] = "("
    path.write_text(json.dumps(good))
    with pytest.raises(ValueError, match=re.escape("datasets.demo.rules[0]")):
        load_rules(str(path))


def test_parameter_files(tmp_path):
    path = tmp_path / "params.json"
    doc = {"schema_version": 1, "default": {"entropy_threshold": 1.5, "max_check_positions": 10, "min_similarity": 0.6, "sample_size": 50}, "datasets": {"a": {"min_similarity": 0.9}}}
    path.write_text(json.dumps(doc))
    assert load_params(str(path), "A").min_similarity == 0.9
    doc["datasets"]["a"]["more"] = 1
    path.write_text(json.dumps(doc))
    with pytest.raises(ValueError, match="unknown fields"):
        load_params(str(path), "a")
    for bad in ({"min_similarity": 1.5}, {"sample_size": 0}, {"max_check_positions": True}, {"entropy_threshold": -1}):
        with pytest.raises(ValueError):
            Params(**bad)
