import random

import corpus_pipeline
from pyspark.sql import functions as F

from weirlog.llm import minhash, suffixes


def corpus(spark, tmp_path):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    passage = " ".join(r.choices(words, k=70))
    rows = []
    for i in range(240):
        text = " ".join(r.choices(words, k=r.randint(30, 200)))
        if i % 8 == 0:
            text += " you vile rotter, vile rotter"
        if i % 10 == 1:
            text = text[:60] + " " + passage + " " + text[60:]
        rows.append((i, text, "en", "abc"[i % 3]))
    rows += [(1000 + i, rows[3][1] + " x", "en", "a") for i in range(5)] + [(2000, None, "en", "a"), (2001, "", None, None), (None, "a text without an id", "en", "b"), (3, rows[3][1], "en", "a")]
    df = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit(1))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, tmp_path):
    sf = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.collect()]
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, sf)
        if name != "packing":
            assert out.schema.simpleString() == docs.schema.simpleString()
        path = f"{tmp_path}/stage{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs.collect())
    ids = [sorted((r["doc_id"] for r in x if r["doc_id"] is not None)) for x in seen]
    assert [i for i in ids[1] if i < 240] == sorted([i for i in range(240) if i % 8] + [3])  # toxic ones go, clean ones stay
    before = spark.createDataFrame(seen[1], "doc_id long, text string, lang string, source string, n_chars long, kept int")
    want = {r["class_id"] for r in minhash.near_duplicates(before).collect() if r["class_id"] is not None}
    assert sorted(want) == ids[2]
    assert 1000 not in ids[2]
    assert ids[2].count(3) == 1
    cut = {r["row"]["doc_id"]: r["kept"] for r in suffixes.remove_repeats(spark.createDataFrame(seen[2], before.schema), as_text=True).collect()}
    assert {r["doc_id"]: r["text"] or "" for r in seen[3]} == {k: v for k, v in cut.items()}
    assert all(r["n_chars"] == len(r["text"] or "") for r in seen[3])
    size = {}
    for r in seen[4]:
        size[r["source"]] = size.get(r["source"], 0) + len(r["text"].split())
    total = sum(len((r["text"] or "").split()) for r in seen[3])
    assert abs(sum(size.values()) - total) < 400
    assert size["a"] < size["b"] < size["c"]
    assert {r["doc_id"] for r in seen[5]} == {r["doc_id"] for r in seen[4]}


def test_run_and_empty(spark, tmp_path):
    sf = corpus(spark, tmp_path / "full")
    assert corpus_pipeline.run(spark, sf).count() > 0
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_different_texts_under_one_id_stay(spark, tmp_path):
    r = random.Random(2)
    a, b, c, d = (" ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(4))
    rows = [(1, a, "s"), (2, a + " x", "s"), (2, b, "t"), (3, b + " y", "s"), (5, c, "z"), (5, c, "a"), (5, d, "s"), (6, d, "s"), (7, None, "s"), (7, "", "s"), (None, a, "s")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{tmp_path}/d")
    want = sorted([(1, a, "s"), (2, b, "t"), (5, c, "a"), (5, d, "s"), (7, None, "s"), (7, "", "s"), (None, a, "s")], key=repr)
    for _ in range(2):
        got = corpus_pipeline.without_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/d"), str(tmp_path)).collect()
        assert sorted(((x["doc_id"], x["text"], x["source"]) for x in got), key=repr) == want


def test_words_taken_with_repeated_ids(spark, tmp_path):
    docs = spark.createDataFrame([(k % 3, " ".join(f"w{k}" for _ in range(k % 5 + 1)), "en", "abc"[k % 3], 1) for k in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mixed(spark, docs, str(tmp_path)).collect()
    assert {tuple(x) for x in got} <= {tuple(x) for x in docs.collect()}
    words = sum(len(x["text"].split()) for x in docs.collect())
    assert abs(sum(len(x["text"].split()) for x in got) - words) <= 15
