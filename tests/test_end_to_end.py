"""The whole way against a plain-Python version (linkage itself is shared: its ties have tests of their own)."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from weirlog import config
from weirlog.operators import clustering
from weirlog.plans import mining


def plain_parse(masked, p):
    tokens = [m.split() for m in masked]
    at = defaultdict(Counter)
    for t in tokens:
        for i, x in enumerate(t[: p.max_check_positions]):
            at[i][x] += 1
    h = {i: -sum(n / c.total() * np.log2(n / c.total()) for n in c.values()) for i, c in at.items()}
    anchors = sorted(i for i, v in h.items() if v < p.entropy_threshold - 1e-12)
    bucket = defaultdict(list)
    for i, t in enumerate(tokens):
        bucket["_".join(f"P{a}:{t[a]}" for a in anchors if a < len(t)) or "NO_ANCHOR"].append(i)
    clusters = []
    for members in bucket.values():
        if len(members) == 1:
            clusters.append(members)
            continue
        sets = [set(tokens[i]) for i in members]
        d = np.array([[1 - len(a & b) / len(a | b) if a | b else 1.0 for b in sets] for a in sets])
        flat = np.sort(d[np.triu_indices(len(sets), 1)])
        if len(flat) == 1:
            cut = flat[0]
        else:
            v = np.abs(np.arange(len(flat)) * (flat[-1] - flat[0]) - (flat - flat[0]) * (len(flat) - 1))
            cut = min(flat[int(np.argmax(v))], 1 - p.min_similarity)
        label = clustering.complete_linkage(d, cut)
        groups = defaultdict(list)
        for i, x in zip(members, label, strict=True):
            groups[x].append(i)
        clusters += groups.values()
    found = []
    for k, c in enumerate(clusters):
        picked = clustering.spread_sample([len(tokens[i]) for i in c], p.sample_size)
        t = tokens[c[picked[0]]]
        for j in picked[1:]:
            t = clustering.align(t, tokens[c[j]])
        found.append((k + 1, c, " ".join(t)))
    events, named, out = {}, {}, {}
    for _, c, t in sorted(found, key=lambda f: -len(f[1])):
        key = re.sub("[^a-zA-Z0-9*]", "", t).lower()
        if key not in events:
            events[key] = f"E{len(events) + 1}"
            named[events[key]] = t
        for i in c:
            out[i] = (events[key], named[events[key]])
    return out


@pytest.mark.parametrize(("seed", "name"), [(1, "hdfs"), (2, "openssh"), (3, "loghub")])
def test_parse_as_python_does(spark, seed, name):
    r = random.Random(seed)
    shapes = ["open file /a/{n} by {u}", "open file /a/{n}", "user {u} failed from 10.0.0.{n} port {n}", "block blk_{n} done", "{u} sent {n} KB to host-{n}:80 in {n} ms", "idle"]
    lines = [r.choice(shapes).format(n=r.randint(1, 200), u=r.choice(["ann", "bob", "cy", "di"])) for _ in range(150)]
    got = mining.parse(spark.createDataFrame(list(enumerate(lines)), "idx long, Content string").repartition(3), name).collect()
    masked = []
    for line in lines:
        for rule in config.RULES[name]:
            line = re.sub(rule.pattern, rule.replacement, line, flags=sum((getattr(re, f) for f in rule.flags), re.NOFLAG))
        masked.append(line.strip())
    assert {x["idx"]: x["masked"] for x in got} == dict(enumerate(masked))
    assert {x["idx"]: (x["event_id"], x["event_template"]) for x in got} == plain_parse(masked, config.params(name))
