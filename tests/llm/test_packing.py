import random
import time
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weirlog.llm import packing

TEXTS = ["", None, "a", "Hello world. This is it! Yes? no", "x" * 5000, "naïve Σ é\u200d👩‍👩‍👧 \x1c\x85\xa0 \t\n\n 12345 don't", "<|endoftext|> inside <|endoftext|>", "word. " * 9000, " " * 3000, "\u3000全角 テスト。", "\ufeffbom \x00 nul", "ß" * 7 + "\n" * 50]


def test_pieces_are_the_ids(spark, documents, clash):
    r = random.Random(1)
    texts = TEXTS + [" ".join(r.choice(["the", "of.", "and", "tion!", "x1\n"]) for _ in range(r.randint(0, 900))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id here."), (3, "again 3")]
    got = packing.pack_documents(clash(documents(rows)).repartition(3)).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*encode.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for i, t in rows if i not in (None, 3)}
    for i, want in ids.items():
        own = sorted((p for p in got if p["doc_id"] == i), key=lambda p: p["start"])
        assert [x for p in own for x in np.frombuffer(p["ids"], dtype="<u4").tolist()] == want
        assert [p["start"] for p in own] == [0, *np.cumsum([len(p["ids"]) // 4 for p in own])[:-1].tolist()]
        assert {p["doc_tokens"] for p in own} == {len(want)}
    assert sum(p["doc_id"] is None for p in got) == 1
    by: dict = {}
    for p in got:
        by.setdefault(p["sequence_id"], []).append((p["offset"], len(p["ids"]) // 4))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            assert n > 0
            at += n
        assert at <= packing.WINDOW


def test_long_runs(spark, documents):
    """Runs that the rank encoder refuses, or takes time with the square of, give the tokenizer file's ids."""
    encode, _ = packing._tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, ("b" * 19_999 + " ") * 20, (" " * 19_999 + "c") * 20, "word  " * 1_000]
    for t in texts:
        began = time.time()
        assert encode(t).tolist() == slow.encode(t, add_special_tokens=False).ids
        assert time.time() - began < 30
    got = packing.pack_documents(documents(list(enumerate(texts)))).groupBy("doc_id").agg(F.sum(F.length("ids") / 4).alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert len(got) == len(texts)
    assert all(r["n"] == r["all"] for r in got)


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    seq = packing.op9_pack_documents(spark, "/root/testdata/sf0.001").groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    used = sum(r["n"] for r in seq)
    paid = sum(r["n"] if r["n"] & (r["n"] - 1) == 0 else packing.WINDOW for r in seq)
    assert docs.count() == 200
    assert used / paid > 0.95


def test_checksums(spark, documents):
    rows = documents([(1, "abc def.")])
    p = packing.pack_documents(rows).withColumn("crc", F.crc32("ids")).first()
    assert p["crc"] == zlib.crc32(p["ids"])


def brute_cost(at, price, window):
    pos, best = [0, *at], [0.0]
    for j in range(1, len(pos)):
        costs = []
        for i in range(j):
            n = pos[j] - pos[i]
            if n <= window:
                costs.append(best[i] + min(window - n, packing.HALF_WINDOW if n == window // 2 else window) + price[j - 1])
        best.append(min(costs))
    return best[-1]


def test_cuts_are_the_cheapest():
    r = random.Random(2)
    for _ in range(200):
        at, price, t = [], [], 0
        for _ in range(r.randint(1, 25)):
            t += r.randint(1, 30)
            at.append(t)
            price.append(r.choice((0.0, 5.0, 20.0)))
        cuts = packing.best_cuts(at, price, 64, True)
        cost, last = 0.0, 0
        for c in cuts:
            n = c - last
            assert 0 < n <= 64
            cost += min(64 - n, packing.HALF_WINDOW if n == 32 else 64) + price[at.index(c)]
            last = c
        assert cuts[-1] == at[-1]
        assert abs(cost - brute_cost(at, price, 64)) < 1e-9


def test_empty_table(spark, documents):
    assert packing.pack_documents(documents([])).count() == 0
