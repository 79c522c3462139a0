import random

from weirlog.llm.common import components
from weirlog.plans import staging


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5), (2000, 2001), (2001, 2000)] + [(3000, 3001 + i) for i in range(50)]
    up = {}

    def root(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {a: root(a) for a in up if root(a) != a}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_staged_tables_can_go(spark):
    paths = []
    with staging.collecting(paths):
        df = staging.stage(spark.range(5), "x")
    assert df.count() == 5
    assert len(paths) == 1
    kept = paths[0]
    staging.drop_staged(spark, paths)
    assert paths == []
    assert kept not in staging._staged
