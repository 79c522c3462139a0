import random
from collections import Counter

import numpy as np
import pytest

from weirlog.llm import minhash
from weirlog.llm.shingles import shingles_of


def shingle_weights(text):
    w = (text or "").split()
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (Counter([tuple(w)]) if w else Counter())
    return {k: 1 + np.log(v) for k, v in c.items()}


def similarity(x, y):
    out = 0.0
    for i in x.keys() & y.keys():
        out += 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys())
    return out


def classes(rows):
    sets = [shingle_weights(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            if rows[i][0] == rows[j][0] or (sets[i].keys() & sets[j].keys() and similarity(sets[i], sets[j]) >= 0.8):
                a, b = root(i), root(j)
                up[a] = b
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(((k, least[root(i)] if k is not None else None) for i, (k, _) in enumerate(rows)), key=repr)


def text(r, n):
    return [r.choice("abcdefghij") + str(r.randint(0, 300)) for _ in range(n)]


def test_against_brute_force(spark, documents, clash, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    r = random.Random(1)
    rows, i = [], 0
    for _ in range(20):
        base = text(r, r.randint(60, 150))
        for _ in range(r.choice((1, 2, 3))):
            w = list(base)
            for _ in range(r.choice((0, 1, 2, 9))):
                w[r.randrange(len(w))] = "edit"
            rows.append((i, " ".join(w)))
            i += 1
    base = text(r, 120)
    for k in range(60):  # a chain of near copies, each an edit away from the last
        base[(k * 2) % 120] = f"e{k}"
        rows.append((1000 + k, " ".join(base)))
    rows += [(2000 + k, "one two three four five six") for k in range(40)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "a b"), (3004, "a  b"), (3005, "a c"), (None, "one two three four five six"), (2000, "one two three four five six"), (3006, " ".join(text(r, 40_000)))]
    rows += [(3007, "\n".join(["same line of words here"] * 30)), (3008, "\n".join(["same line of words here"] * 31))]
    other = [f"far{k} " * 7 for k in range(3)] + [" ".join(text(r, 100))]
    rows += [(4000, other[3]), (4001, other[3] + " tail"), (4001, "quite another text than the first one of this id is"), (4002, "quite another text than the first one of this id is now")]
    got = minhash.near_duplicates(clash(documents(rows)).repartition(5)).collect()
    assert sorted(((x["doc_id"], x["class_id"]) for x in got), key=repr) == classes(rows)
    assert all(x["kept"] == (x["doc_id"] is None or x["doc_id"] == x["class_id"]) for x in got)


def test_signatures_estimate_probability_jaccard():
    r = random.Random(2)
    a = text(r, 400)
    b = a[:300] + text(r, 100)
    texts = [" ".join(a + a[:60]), " ".join(b + b[:90])]
    h, owner, times, _, _ = shingles_of([t.encode() for t in texts], 5)
    w = minhash.weights_of(times)
    sig = minhash.signatures(h, owner, w, 2, slots=4096)
    exact = minhash.probability_jaccard(h[owner == 0], w[owner == 0], h[owner == 1], w[owner == 1])
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03
    x, y = (shingle_weights(t) for t in texts)
    assert abs(exact - similarity(x, y)) < 1e-9


def test_empty_table(spark, documents):
    assert minhash.near_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("direct", [2, 100])
def test_large_groups(spark, documents, monkeypatch, direct):
    """Two near-copy groups that share bands without being alike, over many blocks, and stragglers."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "DIRECT", direct)
    r = random.Random(5)
    base = text(r, 140)
    other = base[:100] + text(r, 40)  # about 0.55 like base: in one group by bands, not linked
    rows = []
    for k in range(90):
        w = list(base if k % 3 else other)
        for _ in range(r.choice((0, 1, 2, 3))):
            w[r.randrange(len(w))] = f"e{r.randint(0, 9)}"
        rows.append((k, " ".join(w)))
    for k in range(20):  # on the way between the two
        rows.append((500 + k, " ".join(base[: 100 + 2 * k] + other[100 + 2 * k :])))
    got = minhash.near_duplicates(documents(rows).repartition(4)).collect()
    assert sorted(((x["doc_id"], x["class_id"]) for x in got), key=repr) == classes(rows)
