import random
import zlib

import duckdb
from pyspark.sql import functions as F

from weirlog.llm import toxicity


def test_grammar():
    m = toxicity.grammar()

    def run(symbols):
        state, out = 0, []
        for s in symbols.split():
            state, o = m.step(state, s)
            out.append(o)
        return " ".join(out)

    assert run("I o I") == "I o I"
    assert run("N o I") == "N o In"
    assert run("N o o o I") == "N o o o I"
    assert run("Y o I") == "Y o Iy"
    assert run("Y o T") == "Y o Ty"
    assert run("R o o o o I I") == "R o o o o Ir Ir"
    assert run("Y N I") == "Y N In"


def test_composition_is_one_after_the_other():
    a = toxicity._window("N", 2, {"I": "In"})
    b = toxicity._window("Y", 2, {"I": "Iy"})
    c = toxicity.compose(a, b, "INYo")
    r = random.Random(1)
    for _ in range(100):
        s1 = s2 = s3 = 0
        for symbol in r.choices("INYo", k=12):
            s1, mid = a.step(s1, symbol)
            s2, want = b.step(s2, mid)
            s3, got = c.step(s3, symbol)
            assert got == want


def test_reports_hold_over_a_colon():
    lexicon, machine = toxicity.Lexicon({"idiot": 2.0}, {}), toxicity.grammar()
    at = toxicity.FEATURES.index
    for text in ("he said you are an idiot", "he said: you are an idiot", "he wrote: this: you are an idiot", "note: he said: you idiot"):
        x = toxicity.features(text, lexicon, machine)
        assert x[at("reported")] > 0 and x[at("targeted")] == 0, text
    for text in ("look: you are an idiot", "he said so. you are an idiot", "a: b: you idiot"):
        x = toxicity.features(text, lexicon, machine)
        assert x[at("targeted")] > 0 and x[at("reported")] == 0, text
    long = "calm words and " * 20_000 + "you idiot"  # one clause
    assert toxicity.features(long, lexicon, machine)[at("targeted")] > 0


def test_long_texts_and_both_labels(spark, documents):
    rows = [(i, f"text {i} plain") for i in range(1, 40)] + [(100, "idiot " * 20_000), (101, "you idiot")]
    labels = spark.createDataFrame([(i, 0) for i in range(1, 40)] + [(100, 1), (101, 1), (101, 0), (101, 1)], "doc_id long, toxic int")
    model = toxicity.train(documents(rows), labels, body=1_000)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(documents(rows), model).collect()}
    assert len(got) == 41 and all(0 <= v <= 1 for v in got.values())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op8_toxicity(spark, sf).collect()
    assert len(rows) == 10_000
    truth = dict(duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall())
    tp = fp = fn = 0
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)
        if r["held_out"] and r["doc_id"] in truth:
            y = truth[r["doc_id"]]
            tp, fp, fn = tp + (y and r["predicted"]), fp + (not y and r["predicted"]), fn + (y and not r["predicted"])
    assert tp / (tp + fp) > 0.85
    assert tp / (tp + fn) > 0.85


def test_odd_rows(spark, documents, clash):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefg") for _ in range(5)) for _ in range(200)]
    text = lambda bad: " ".join(r.choices(words, k=40)) + (" you vile " + " ".join(r.choices(words, k=3)) + " rotter." if bad else ".")
    rows = [(i, text(i % 4 == 0)) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    docs = clash(documents([*rows, (900, None), (901, ""), (None, text(True)), (902, "vile " * 30_000), (0, rows[0][1])]))
    model = toxicity.train(docs, labels)
    assert {"vile", "rotter"} <= set(model.insults)
    got = toxicity.score_toxicity(docs, model)
    assert got.count() == 205
    assert got.where("doc_id = 900").first()["score"] == got.where("doc_id = 901").first()["score"]
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert kept.where(F.col("doc_id") < 200).count() == 150
    none = toxicity.train(documents([]), labels.limit(0))
    assert toxicity.score_toxicity(documents([]), none).count() == 0
