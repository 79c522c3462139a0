import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weirlog.llm import suffixes
from weirlog.llm.shingles import prefix_hash


def brute(rows):
    """By (id, hash order of texts with one id is not checked): ids must be different or texts equal."""
    seen, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    done = {}
    for i, t in order:
        b = (t or "").encode()
        key = (i, b)
        if key not in done:
            mask = bytearray(len(b))
            for k in range(len(b) - 99):
                w = b[k : k + 100]
                if w in seen:
                    mask[k : k + 100] = b"\x01" * 100
                else:
                    seen[w] = True
            kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
            spans = sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask))
            done[key] = (i, len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest())
        out.append(done[key])
    return sorted(out, key=repr)


def found(df, **options):
    r = suffixes.remove_repeats(df, **options)
    rows = r.select("row.doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("k")).collect()
    return sorted((tuple(x) for x in rows), key=repr)


def words(r, n):
    return " ".join("".join(r.choice("abcdé") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.mark.parametrize("crowd", [4000, 20])
def test_against_brute_force(spark, documents, clash, crowd):
    r = random.Random(crowd)
    passage = words(r, 50)
    rows = [(i, words(r, r.randint(5, 30)) + " " + passage + " " + words(r, r.randint(0, 30))) for i in range(80)]
    rows += [(200 + i, "na " * r.randint(20, 120) + words(r, 3)) for i in range(15)]
    rows += [(400, None), (401, ""), (402, "é" * 80), (403, "x" + "é" * 80), (404, "a" * 4000), (405, "a" * 99), (406, "a" * 100), (407, "ab" * 200), (None, passage), (7, rows[7][1]), (7, rows[7][1])]
    long = words(r, 6000)
    rows += [(500, long), (501, long[:9000] + "X" + long[9000:]), (502, long)]
    df = clash(documents(rows)).repartition(6)
    assert found(df, crowd=crowd) == brute(rows)


def test_texts_lose_broken_characters(spark, documents):
    rows = [(1, "é" * 60), (2, "x" + "é" * 60 + "yz")]
    r = suffixes.remove_repeats(documents(rows), as_text=True).collect()
    assert {x["row"]["doc_id"]: x["kept"] for x in r}[2] == "xyz"


def test_empty_table(spark, documents):
    assert suffixes.remove_repeats(documents([])).count() == 0


def test_suffix_sort():
    r = random.Random(9)
    data = np.frombuffer("".join(r.choice("ab") for _ in range(700)).encode(), dtype=np.uint8)
    at = np.array(r.sample(range(500), 300))
    bucket = np.sort(np.array([r.randint(0, 4) for _ in at]))
    got = suffixes.sort_suffixes(data, prefix_hash(data), at, bucket, 100)
    raw = data.tobytes()
    want = sorted(range(len(at)), key=lambda i: (bucket[i], raw[at[i] : at[i] + 100], i))
    assert got.tolist() == want


def test_lying_hashes_are_found_out(monkeypatch):
    """With hashes that always agree, bytes decide."""
    r = random.Random(10)
    contexts = [words(r, 40).encode()[:120] for _ in range(6)]
    contexts += contexts[:2]
    n = len(contexts)
    args = (contexts, np.zeros(n, np.int64), np.full(n, 10), np.arange(n), np.zeros(n, np.int64))
    honest = suffixes._gone_windows(*args)[0]
    monkeypatch.setattr(suffixes, "common_prefix", lambda prefix, down, x, y, most: np.full(len(x), most))
    lied = suffixes._gone_windows(*args)[0]
    assert [a.tolist() for a in lied] == [a.tolist() for a in honest]


def test_anchors_depend_on_windows_alone():
    r = random.Random(11)
    a, b, core = words(r, 30).encode(), words(r, 31).encode(), words(r, 60).encode()
    runs = []
    for before in (a, b):
        data = np.frombuffer(before + core, dtype=np.uint8)
        lo, hi, at, h, _ = suffixes.anchor_runs(data, np.array([0, len(data)]))
        runs.append({int(s) - len(before): (int(x) - len(before), int(v)) for i, j, x, v in zip(lo, hi, at, h, strict=True) for s in range(i, j + 1) if s >= len(before)})
    assert runs[0] == runs[1]
    assert runs[0]


def batch_of(texts):
    return pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array([b""] * len(texts), pa.binary()), pa.array(texts, pa.string())], names=["did", "tag", "body"])


def covered(rows):
    return {(r["did"], k) for r in rows for k in range(r["begin"], r["end"])}


def test_lying_hashes_on_every_path(monkeypatch):
    """Anchors, contexts and crowds under hashes that are always 0: nothing goes that bytes do not repeat."""
    r = random.Random(12)
    passage = words(r, 40)
    texts = [words(r, 20) + passage, words(r, 20), passage + words(r, 10), words(r, 30), words(r, 20) + passage]
    want, seen = set(), set()
    for i, t in enumerate(texts):
        b = t.encode()
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                want |= {(i, x) for x in range(k, k + 100)}
            seen.add(b[k : k + 100])
    monkeypatch.setattr(suffixes, "prefix_hash", lambda data: np.zeros(len(data) + 1, np.uint64))
    monkeypatch.setattr(suffixes, "common_prefix", lambda prefix, down, x, y, most: np.full(len(x), most))
    runs = [x for b in suffixes._find_runs(iter([batch_of(texts)]), np.zeros(0, np.int64)) for x in b.to_pylist()]
    known = covered([{"did": x["did"], "begin": x["lo"], "end": x["c1"]} for x in runs if x["known"]])
    assert known <= want
    raw = [t.encode() for t in texts]
    rows = [(x["h"], x["did"], x["tag"], x["lo"], x["left"], raw[x["did"]][x["lo"] : x["lo"] + x["span"] + 100]) for x in runs if not x["known"]]
    asked = pa.RecordBatch.from_pylist([dict(zip(("h", "did", "tag", "begin", "left", "bytes"), x, strict=True)) for x in rows])
    compared = covered([x for b in suffixes._compare_contexts(iter([asked])) for x in b.to_pylist()])
    assert known | compared == want
    out = [x for b in suffixes._crowd_windows(iter([asked])) for x in b.to_pylist()]
    digest = {}
    for x in out:
        if x["kind"]:
            window = raw[x["did"]][x["begin"] : x["end"]]
            assert digest.setdefault((x["w1"], x["w2"]), window) == window
    assert covered([x for x in out if not x["kind"]]) | known == want


def test_texts_with_one_id_or_none(spark, documents):
    """Different texts without an id, or under one id, are documents of their own."""
    r = random.Random(13)
    one, two = (words(r, 40)[:129] for _ in range(2))
    for ids in ((None, None), (5, 5)):
        df = documents([(ids[0], one), (ids[1], two), (9, one)])
        got = suffixes.remove_repeats(df).select("row.text", "row.doc_id", "n_removed").collect()
        assert sorted((x["text"], x["doc_id"] or 0, x["n_removed"]) for x in got) == sorted([(one, ids[0] or 0, 0 if ids[0] else len(one.encode())), (two, ids[1] or 0, 0), (one, 9, len(one.encode()) if ids[0] else 0)])


def test_hot_anchor(spark, documents):
    """A line in every document, always with other neighbours: its anchors are hot and dealt out by context."""
    r = random.Random(14)
    line = words(r, 30)
    rows = [(i, f"{words(r, 12)}\n{line[: 90 + i % 40]}\n{words(r, 12)}") for i in range(400)]
    df = documents(rows).repartition(5)
    source = df.select(F.col("doc_id").alias("did"), F.lit(b"").alias("tag"), F.col("text").alias("body"))
    assert len(suffixes.hot_anchors(source, 50))
    assert found(df) == brute(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        assert found(df) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
