import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirlog import config, functions
from weirlog.config import Params
from weirlog.operators import buckets, clustering, events, patterns, replay, similarity
from weirlog.plans import mining


def test_alignment():
    assert clustering.align("a b c".split(), "a x c".split()) == "a <*> c".split()
    assert clustering.align("x <*>".split(), "y <*>".split()) == ["<*>"]
    assert clustering.align("<*> x".split(), "<*> y".split()) == ["<*>", "<*>"]
    assert clustering.align(["a"], []) == ["<*>"]


def test_spread_sample():
    assert clustering.spread_sample([1] * 50, 50) == list(range(50))
    got = clustering.spread_sample([1] * 51, 50)
    assert got[:2] == [0, 50]
    assert got[2:] == [r for r in dict.fromkeys(int(1 + i * 49 / 48) for i in range(1, 49)) if r not in (0, 50)]
    with pytest.raises(ValueError):
        clustering.spread_sample([1, 2, 3], 2)


def plain_elbow(d, tau):
    d = np.sort(d)
    if len(d) <= 1:
        return d[0] if len(d) else 0.5
    v = np.abs(np.arange(len(d)) * (d[-1] - d[0]) - (d - d[0]) * (len(d) - 1))
    return min(d[int(np.argmax(v))], 1 - tau)


def test_elbow_with_multiplicities(spark):
    rng = random.Random(1)
    assert clustering.elbow(np.array([0.9]), np.array([1]), 1, 0.85) == 0.9
    assert clustering.elbow(np.array([0.4]), np.array([3]), 3, 0.85) == pytest.approx(0.15)
    rows, want = [], {}
    for case in range(25):
        values = [rng.choice([0.0, 0.25, 0.5, 0.75, 1.0]) for _ in range(rng.randint(1, 30))]
        u, n = np.unique(values, return_counts=True)
        want[f"b{case}"] = plain_elbow(np.array(values), 0.4)
        assert clustering.elbow(u, n, len(values), 0.4) == pytest.approx(want[f"b{case}"])
        rows += [(f"b{case}", i, i + 1, v) for i, v in enumerate(values)]
    got = similarity.elbow_cutoffs(spark.createDataFrame(rows, "bucket string, i long, j long, d double"), 0.4).collect()
    assert {r["bucket"]: r["cutoff"] for r in got} == pytest.approx(want)


def test_complete_linkage_properties():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sets = [frozenset(rng.integers(0, 8, size=rng.integers(1, 6)).tolist()) for _ in range(15)]
        d = clustering.distance_matrix([frozenset(map(str, s)) for s in sets])
        label = clustering.complete_linkage(d, 0.5)
        groups = [np.flatnonzero(label == x) for x in np.unique(label)]
        np.fill_diagonal(d, 0)
        assert all(d[np.ix_(g, g)].max() <= 0.5 for g in groups)
        assert all(d[np.ix_(a, b)].max() > 0.5 for i, a in enumerate(groups) for b in groups[:i])


def test_two_messages_always_join_and_blank_ones_do_not():
    assert clustering.cluster_messages([["a"], ["b"]], 0.6) == [[0, 1]]
    assert clustering.cluster_messages([[], [], ["a"], ["a"]], 0.6) == [[0], [1], [2, 3]]
    assert clustering.cluster_messages([["a"], ["b"]], 0.6, fixed=0.5) == [[0], [1]]


def test_leaders_follow_a_sample():
    n = clustering.SAMPLE_LIMIT + 10
    groups = clustering.cluster_messages([["x", "y", str(i % 3)] for i in range(n)], 0.0, fixed=0.7)
    assert sorted(map(len, groups)) == sorted(sum(1 for i in range(n) if i % 3 == k) for k in range(3))


def test_entropy_and_buckets(spark):
    lines = ["Received block <*> from <*>"] * 2 + ["Deleted block <*> on <*>"] * 2
    df = buckets.items(spark.createDataFrame(list(enumerate(lines)), "idx long, masked string"))
    h = buckets.positional_entropy(df, 15)
    assert {r["pos"]: r["entropy"] for r in h.collect()} == {0: 1.0, 1: 0.0, 2: 0.0, 3: 1.0, 4: 0.0}
    assert buckets.anchors(h, 1.0) == [1, 2, 4]
    got = buckets.with_bucket(df, [1, 2, 4]).select("bucket").distinct().collect()
    assert [r[0] for r in got] == ["P1:block_P2:<*>_P4:<*>"]


def test_quick_demo_and_partitions(spark):
    lines = ["Received block blk_123 from 10.0.0.1:50010", "Received block blk_456 from 10.0.0.2:50010", "Deleted block blk_123 on /data/node-a", "Deleted block blk_456 on /data/node-b"]
    seen = set()
    for n in (1, 7):
        df = spark.createDataFrame(list(enumerate(lines)), "idx long, Content string").repartition(n)
        got = mining.parse(df, "hdfs").orderBy("idx").collect()
        seen.add(tuple((r["event_id"], r["event_template"]) for r in got))
    assert seen == {(("E1", "Received block <*> from <*>"),) * 2 + (("E2", "Deleted block <*> on <*>"),) * 2}


def test_large_inputs_are_replayed(spark):
    rng = random.Random(5)
    rows = [(i, f"open file {rng.randint(1, 9)} by {rng.choice(['ann', 'bob', 'cyd'])}" if i % 3 else f"close file {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "idx long, Content string")
    s = mining.settings("loghub")
    masked = mining.masked_rows(df, "loghub")
    model = mining.fit(masked, s, full_parse_rows=100, top=2)
    assert not model.full
    got = mining.transform(model, masked).collect()
    assert len(got) == 300
    assert {r["source"] for r in got} == {"exact", "nearest"}


def test_variants_and_quadrants(spark):
    rows = [(i, f"job {i} started on node-{i % 4}" if i % 2 else f"job {i} failed code {i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "idx long, Content string")
    for name in mining.VARIANTS:
        s = mining.variant(name, "spark")
        masked = mining.masked_rows(df, s.format)
        got = mining.transform(mining.fit(masked, s, full_parse_rows=10, top=20), masked)
        assert got.count() == 60
    with pytest.raises(ValueError):
        mining.variant("none", "spark")
    assert mining.quadrant("HDFS", "U-T").format == "loghub"
    assert mining.quadrant("HDFS", "T-U").params == Params(1.5, 12, 0.65)
    with pytest.raises(ValueError):
        mining.quadrant("HDFS", "X")


def test_events_by_size(spark):
    rows = [(1, 2, "Task <*> done"), (2, 5, "task <*> done!"), (3, 2, "other"), (4, 2, "more")]
    got = events.number_events(spark.createDataFrame(rows, "cluster_id int, log_count long, template string")).collect()
    assert {r["cluster_id"]: (r["event_id"], r["event_template"]) for r in got} == {1: ("E1", "task <*> done!"), 2: ("E1", "task <*> done!"), 3: ("E2", "other"), 4: ("E3", "more")}


def python_nearest(text, templates, inclusive):
    p, best, out = set(text.split()), 0.0, "E99"
    for e, t in templates:
        s = set(t.split())
        if abs(len(p) - len(s)) > 12:
            continue
        score = len(p & s) / len(p | s) if p | s else 0.0
        if score > best:
            best, out = score, e
        if score > 0.85 or (inclusive and score >= 0.85):
            return e
    return out


def test_nearest_templates(spark):
    rng = random.Random(3)
    words = "a b c d e f g h".split()
    templates = [(f"E{i + 1}", " ".join(rng.choices(words, k=rng.randint(1, 6)))) for i in range(12)]
    strings = sorted({" ".join(rng.choices([*words, "z"], k=rng.randint(1, 7))) for _ in range(80)} | {"q", "", "z " * 3 + " ".join(f"w{i}" for i in range(20))})
    ev = spark.createDataFrame([(i + 1, e, t) for i, (e, t) in enumerate(templates)], "event_ord int, event_id string, event_template string")
    df = spark.createDataFrame([(s,) for s in strings], "masked string")
    for inclusive in (False, True):
        got = {r["masked"]: r["event_id"] for r in replay.nearest_templates(df, ev, inclusive=inclusive).collect()}
        assert got == {s: python_nearest(s, templates, inclusive) for s in strings}


def test_canonical_replay(spark):
    trained = spark.createDataFrame([("open x1", "E1", 1), ("open x2", "E2", 2)], "masked string, event_id string, cluster_id int")
    ev = spark.createDataFrame([(1, "E1", "open <*>"), (2, "E2", "shut <*>")], "event_ord int, event_id string, event_template string")
    rows = spark.createDataFrame([(0, "open x2"), (1, "open x9"), (2, "shut y7 now"), (3, "shut y8 now"), (4, "zzz")], "idx long, masked string")
    got = {r["idx"]: (r["event_id"], r["source"]) for r in replay.replay_canonical(rows, trained, ev).collect()}
    assert got == {0: ("E2", "exact"), 1: ("E1", "canonical"), 2: ("E2", "nearest"), 3: ("E2", "memo"), 4: ("E99", "nearest")}
    c = replay.replay_counters(replay.replay_canonical(rows, trained, ev)).first()
    assert (c["rows"], c["cache_hits"], c["fallbacks"]) == (5, 3, 2)


def test_prefixes(spark):
    trained = spark.createDataFrame([("a b", "E1", 1), ("a b c", "E2", 2), ("a  b", "E3", 3)], "masked string, event_id string, cluster_id int")
    strings = spark.createDataFrame([("a b x",), ("a b c d",), ("a b x y z",), ("q",), ("",)], "masked string")
    got = {r["masked"]: r["event_id"] for r in replay.prefix_matches(strings, trained).collect()}
    assert got == {"a b x": "E3", "a b c d": "E2", "a b x y z": None, "q": None, "": None}


def python_pattern(messages):
    import re
    from collections import Counter

    def kind(t):
        for name, p in (("number", r"^-?\d+(\.\d+)?$"), ("ip", r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), ("path", r"^(/[\w\-./]+)|([A-Za-z]:\\[\w\-\\.]+)$"), ("hex", r"^0x[0-9a-fA-F]+$"), ("date", r"^\d{4}-\d{2}-\d{2}$")):
            if re.match(p, t):
                return name
        return "literal"

    if len(messages) == 1:
        return " ".join(messages[0])
    least, out = min(map(len, messages)), []
    for p in range(max(map(len, messages))):
        col = [m[p] for m in messages if p < len(m)]
        if p >= least:
            if len(col) > len(messages) * 0.2:
                out.append("<*>")
            continue
        kinds = Counter(map(kind, col))
        top, different = kinds.most_common(1)[0][0], len(set(col))
        wild = len(kinds) > 1 or (top in ("number", "ip", "path", "hex") and different > 1) or (top == "literal" and different / len(col) > 0.3)
        out.append("<*>" if wild else Counter(col).most_common(1)[0][0])
    return " ".join(t for i, t in enumerate(out) if t != "<*>" or i == 0 or out[i - 1] != "<*>")


def test_patterns(spark):
    rng = random.Random(4)
    vocabulary = ["a", "b", "12", "7", "/x/y", "/z", "0x1f", "2020-01-01", "2021-01-01", "1.2.3.4"]
    rows, want, i = [], {}, 0
    for c in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 5))]
        messages = []
        for _ in range(rng.choice((1, 2, 8, 12))):
            m = [t if rng.random() < 0.85 else rng.choice(vocabulary) for t in base] + ["t"] * rng.choice((0, 0, 0, 1, 2))
            messages.append(m)
            rows.append((i, m, c))
            i += 1
        want[c] = python_pattern(messages)
    got = patterns.mine_patterns(spark.createDataFrame(rows, "idx long, tokens array<string>, cluster_id int")).collect()
    assert {r["cluster_id"]: r["template"] for r in got} == want


def test_pairs(spark):
    df = spark.createDataFrame([(0, ["a", "b"], "x"), (1, ["b", "b"], "x"), (2, [], "x"), (3, [], "x")], "idx long, tokens array<string>, bucket string")
    got = {(r["i"], r["j"]): r["d"] for r in similarity.pair_distances(df).collect()}
    assert got == {(0, 1): 0.5, (0, 2): 1.0, (0, 3): 1.0, (1, 2): 1.0, (1, 3): 1.0, (2, 3): 1.0}


def test_top_strings(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate("b a a c b d".split())], "idx long, masked string")
    assert [(r["idx"], r["masked"], r["n"]) for r in buckets.top_strings(df, 3).orderBy("idx").collect()] == [(0, "b", 2), (1, "a", 2), (2, "c", 1)]


def test_sweep_skips_done(spark):
    df = spark.createDataFrame([(i, str(i), f"x {i}", "x <*>") for i in range(6)], "idx long, LineId string, Content string, EventTemplate string")
    got = mining.sweep(df, "loghub", [0.5, 1.5], "EventTemplate", done=[0.5]).collect()
    assert [(r["threshold"], r["PA"]) for r in got] == [(1.5, 1.0)]
    with pytest.raises(ValueError):
        mining.sweep(df, "loghub", [0.5], "EventTemplate", done=[0.5])


def test_empty_input(spark):
    df = spark.createDataFrame([], "idx long, Content string")
    assert mining.parse(df, "hdfs").count() == 0
    assert df.select(F.lit(1)).count() == 0


def test_lines_and_own_masks(spark):
    got = mining.parse_lines(spark, ["a 1", "a 2"], "loghub").collect()
    assert {r["event_template"] for r in got} == {"a <*>"}
    df = spark.createDataFrame([(0, "Hello")], "idx long, Content string")
    assert mining.masked_rows(df, F.upper).first()["masked"] == "HELLO"
    assert set(functions.MASKS) == set(config.formats())
    assert spark.range(1).select(functions.MASKS["hdfs"](F.lit("blk_1 2"))).first()[0] == "<*> <*>"


def test_done_thresholds(spark):
    rows = [("HDFS", 0.5, 0.9), ("HDFS", 1.0, None), ("BGL", 1.5, 0.1)]
    assert mining.done_thresholds(spark.createDataFrame(rows, "Dataset string, EntropyThreshold double, FTA double"), "HDFS") == [0.5]


def test_mined_clusters_take_all_training_strings(spark):
    from weirlog import queries

    sf = "/root/testdata/sf0.01"
    different = queries._lines(spark, sf).select("masked").distinct().count()
    assert queries.QUERIES["mined_clusters"](spark, sf).count() == different > 200


def test_variants_and_quadrants_parse_as_production(spark, monkeypatch):
    from weirlog import queries

    class Seen(Exception):
        pass

    def fit(rows, s, *, full_parse_rows=mining.FULL_PARSE_ROWS, top=mining.TOP_STRINGS):
        raise Seen(full_parse_rows, top)

    monkeypatch.setattr(mining, "fit", fit)
    for name in ("variant_nobucket", "quadrant_u_t"):
        with pytest.raises(Seen) as seen:
            queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert seen.value.args == (50_000, 8_000)
