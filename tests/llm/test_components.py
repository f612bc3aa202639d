import random

import numpy as np

from threadlake.llm.components import components, forest


def test_same_as_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = components(spark.createDataFrame([*edges, (None, 1), (7, 7)], "a long, b long")).collect()
    assert {(r["node"], r["root"]) for r in got} == {(x, find(x)) for x in root} and len(got) == len(root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_joins_the_same_nodes():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (40, 30), (500, 400), (300, 4000)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        thin = forest(u, v)
        low = {int(x): int(x) for x in np.append(u, v)}
        for _ in range(n):
            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                low[a] = low[b] = min(low[a], low[b])
        assert {x: y for x, y in low.items() if x != y} == dict(zip(thin["u"].tolist(), thin["v"].tolist(), strict=True))
