import numpy as np
import pytest

from weirlog.llm import vectors


def brute(rows, least=0.93):
    good = [i for i, (k, v, label) in enumerate(rows) if k is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, up = dict.fromkeys(range(len(rows)), 0), list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    unit = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in good}
    unit = {i: x / np.sqrt((x * x).sum()) for i, x in unit.items()}
    for n, i in enumerate(good):
        for j in good[:n]:
            if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[a] = b
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    first = {i: min((rows[j][0] for j in g if rows[j][0] is not None), default=None) for g in groups.values() for i in g}
    return sorted(((rows[i][0], links[i], first[i] if links[i] else rows[i][0]) for i in range(len(rows))), key=repr)


def found(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.vector_links(df).collect()), key=repr)


def test_odd_vectors(spark, clash):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [1.0, None], 1), (9, [float("nan"), 1.0], 1),
        (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.0], None), (12, [1e200, 0.0], 1), (13, [1e-200, 0.0], 1), (14, [1.0, 0.0], 1), (14, [1.0, 0.0], 1), (15, [-1.0, 0.0], 1), (None, [1.0, 0.0], 1), (16, [float("inf"), 1.0], 1),
    ]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert found(df.repartition(3)) == brute(rows)


def test_different_vectors_under_one_id(spark):
    """One row a vector; vectors that share an id keep their own links and components."""
    rows = [(1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.01, 0.0], 1), (2, [0.0, 1.0, 0.0], 1), (3, [0.0, 1.0, 0.01], 1), (3, [0.0, 0.0, 1.0], 1), (3, [0.0, 0.0, 1.0], 1), (4, [0.0, 1.0, 0.0], 1)]
    got = vectors.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted([(1, 1, 1), (2, 1, 1), (2, 2, 2), (3, 2, 2), (3, 1, 3), (3, 1, 3), (4, 2, 2)])
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_empty_table(spark):
    assert vectors.vector_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def near(rng, x, c):
    y = rng.normal(size=x.shape)
    y -= (y @ x) * x
    y /= np.linalg.norm(y)
    return c * x + np.sqrt(1 - c * c) * y


def test_recall_and_groups(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1500, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(base)]
    rows += [(2000 + i, near(rng, base[i], 0.931 + 0.0005 * (i % 100)).tolist(), i % 2) for i in range(600)]
    rows += [(4000 + i, near(rng, base[0], 0.99).tolist(), 0) for i in range(300)]  # a group of near copies
    rows += [(5000 + i, base[1].tolist(), 1) for i in range(300)]  # a group of copies
    monkeypatch.setattr(vectors, "BLOCK", 128)
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4))
    want = brute(rows)
    assert sum(x[1] for x in got) >= 0.97 * sum(x[1] for x in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    small = dict((x[0], x[1:]) for x in got)
    assert small[5000] == (300 + (small[1][0] - 300), 1)


def test_estimates_miss_nothing_in_a_list():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = vectors.fit(x, 4)
    near_lists = model.home(x, 4)
    codes, left = model.encode(x, near_lists[:, 0])
    t = model.tables(x)
    guess = x @ model.centroids[near_lists[:, 0]].T
    for m in range(codes.shape[1]):
        guess += t[:, m, :][:, codes[:, m]]
    assert (np.abs(guess - x @ x.T) <= left[None, :] + 1e-9).all()
    assert np.median(left) < 0.9
    with pytest.raises(ValueError):
        model.home(np.zeros((1, 5)), 2)
