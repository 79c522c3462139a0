import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from weirlog.llm import mixing


def water(sizes, weights, epochs):
    """Targets by resharing the excess until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, left = Fraction(sum(sizes.values())), {}, set(names)
    rest = total
    while left:
        level = rest / sum(w[s] for s in left)
        over = [s for s in left if w[s] * level > epochs * sizes[s]]
        if not over:
            target |= {s: w[s] * level for s in left}
            break
        for s in over:
            target[s] = Fraction(epochs * sizes[s])
            rest -= target[s]
            left.discard(s)
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_budgets(spark, documents, clash, seed):
    r = random.Random(seed)
    rows = [(i, " ".join("word" for _ in range(r.choice((0, 1, 3, 40)))), "en", r.choice(["a", "b", "é", "z", None, "Z"]) if i % 3 else "a") for i in range(300)]
    rows += [(5, "x y", "en", "a"), (5, "x y", "en", "a"), (None, "n n n", "en", "b"), (900, None, "en", "q"), (901, "", "en", "q"), (902, "v " * 50_000, "en", "z")]
    docs = clash(documents(rows).withColumn("source", F.col("source")))
    got = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["taken"]) for x in got) == sorted((x["doc_id"] is None, x["doc_id"] or 0, x["taken"]) for x in mixing.mix_sources(docs.coalesce(1)).collect())
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = water(sizes, (1, 2, 3), 3)
    assert len(got) == len(rows)
    for source in sizes:
        own = [x for x in got if x["source"] == source]
        assert own[0]["source_size"] == sizes[source]
        assert own[0]["target"] == pytest.approx(float(want[source]))
        assert sum(x["taken"] for x in own) == int(float(own[0]["target"]))
        assert all(0 <= x["taken"] <= 3 * x["size"] for x in own)


def test_buckets_do_not_change_the_result(spark, documents, monkeypatch):
    docs = documents([(i, "w " * (i % 7 + 1), "en", "ab"[i % 2]) for i in range(200)])
    one = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs).collect()}
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 9)
    assert {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs).collect()} == one


def test_quality_draws_more(spark, documents):
    docs = documents([(i, "aaaa bbbb cccc" if i % 2 else "#### %%%% &&&&", "en", "a" if i < 400 else "b") for i in range(600)])
    rows = mixing.mix_sources(docs, weights=(1, 5), cut=False).where("source = 'a'").collect()
    good = sum(r["taken"] > 0 for r in rows if r["doc_id"] % 2)
    bad = sum(r["taken"] > 0 for r in rows if not r["doc_id"] % 2)
    assert good > 2 * bad
    assert {r["taken"] % r["size"] for r in rows} == {0}


def test_empty_table(spark, documents):
    assert mixing.mix_sources(documents([]), carry=True).count() == 0


def test_buckets_are_even(spark):
    """A tenth of the documents at the least weight and the rest at 0.8, or weights all over: no bucket is much larger than the others."""
    for w in (F.when(F.col("id") % 10 == 0, 0.05).otherwise(0.8), 0.05 + 0.95 * F.rand(3), F.lit(0.7)):
        d = spark.range(200_000).select(F.lit("a").alias("source"), F.lit(1).alias("size"), w.alias("w"), (-F.log(F.rand(5))).alias("e")).withColumn("key", F.col("e") / F.col("w"))
        sources = mixing._sources(d).withColumn("buckets", F.lit(200))
        n = [r["count"] for r in d.join(F.broadcast(sources.drop("source_size")), "source").withColumn("bucket", mixing._bucket()).groupBy("bucket").count().collect()]
        assert sum(n) == 200_000
        assert len(n) == 200
        assert max(n) <= 2 * sorted(n)[100]
