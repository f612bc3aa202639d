"""Mined negatives against plain loops over all rows, and the bounds against exact scores."""

import numpy as np
import pytest

from threadlake.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, g string, key string, score string"


def plain(rows, every=100, p=5, k=10, least=30, most=90):
    kept = set()
    for i, v, lab in rows:
        if i is not None and lab is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            kept.add((i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)))
    out = []
    for a in kept:
        if a[0] % every:
            continue
        score = {r: sum(x * y for x, y in zip(a[2], r[2], strict=True)) for r in kept if r != a}
        near = sorted((-s, r[0]) for r, s in score.items() if r[1] == a[1])[:p]
        far = sorted((-s, r[0]) for r, s in score.items() if r[1] != a[1])
        for s, i in near:
            inside = [(n, j) for n, j in far if least * -s <= 100 * -n <= most * -s][:k]
            out += [(a[0], i, rank, j, -s, -n) for rank, (n, j) in enumerate(inside, 1)]
    return sorted(out)


def rows_of(seed, n, width=9):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (12, width))
    rows = [(int(i), (centres[rng.integers(12)] + rng.normal(0, 0.15, width)).astype(np.float32).tolist(), int(rng.integers(10))) for i in range(n)]
    hot = rows[3][1]
    rows += [(n + i, hot, int(i % 3)) for i in range(n // 3)]  # a third of the rows share a vector
    return rows + [rows[0], rows[0], (100, hot, 4), (None, hot, 1), (n * 5, None, 1), (n * 5 + 1, hot, None), (n * 5 + 2, [None] * width, 2), (n * 5 + 3, [float("nan")] * width, 2), (200, [0.0] * width, 2)]


@pytest.mark.parametrize(("seed", "n", "row_block", "anchor_block"), [(1, 80, 8192, 8192), (2, 400, 60, 3), (3, 1500, 300, 8)])
def test_equals_plain_loops(spark, seed, n, row_block, anchor_block):
    rows = rows_of(seed, n)
    every = 10 if n < 100 else 50
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(4)
    got = negatives.mine(df, every=every, row_block=row_block, anchor_block=anchor_block).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, every)


def test_bounds_hold_and_leave_out_most(spark):
    import pandas as pd

    rng = np.random.default_rng(9)
    x = rng.integers(-200, 200, (3000, 16))
    part = [negatives._train(pd.DataFrame({"part": i, "key": range(3000), "values": list(x[:, 2 * i : 2 * i + 2])})) for i in range(8)]
    books = [np.array(p["entries"][0]).reshape(-1, 2) for p in part]
    pdf = pd.DataFrame({"key": range(3000), "g": range(3000), "rep": range(3000), "label": 1, "x": list(x)})
    block = negatives._Block(pd.concat(negatives._encode(books)([pdf])), books)
    low, high = block.bounds(x[:50])
    exact = x[:50] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    assert ((high >= negatives._kth(low, 5)[:, None]).sum(axis=1) < 300).all()


def test_empty_tables(spark):
    for rows in ([], [(100, None, 2, "x", "y", "z"), (200, [float("nan")] * 4, 1, None, None, None)], [(100, [0.5] * 4, 2, "x", "y", "z")], [(1, [0.5] * 4, 2, "x", "y", "z")]):
        assert negatives.mine(spark.createDataFrame(rows, SCHEMA)).collect() == []
