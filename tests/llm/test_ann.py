import numpy as np

from threadlake.llm.ann import nearest


def by_force(rows, every, k):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float) != 0)]
    out = {}
    for i, v in rows:
        if i % every == 0:
            out[i] = sorted(((-float((v * w).sum()), j) for j, w in rows if j != i))[:k]
    return out


def test_recall_ties_and_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 900)] + 0.3 * rng.normal(size=(900, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[0].tolist()) for i in range(60)]  # copies of a query's vector
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [float("inf")] * 16), (None, x[1].tolist())]
    df = spark.createDataFrame([(i, v, 0, "c") for i, v in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = {}
    for r in nearest(df, 20, 10, shard_vectors=300).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    want = by_force(rows, 20, 10)
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _, _ in got[q]} & {v for _, v in want[q]}) for q in want)
    assert hits >= 0.97 * sum(map(len, want.values()))
    assert [v for v, _, _ in got[0]] == [v for _, v in want[0]]  # all ties: smallest ids first
    for q, found in got.items():
        assert [r for _, _, r in found] == list(range(1, 11)) and q not in {v for v, _, _ in found}
        assert [(-s, v) for v, s, _ in found] == sorted((-s, v) for v, s, _ in found)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], schema), 20, 5).count() == 0
    assert nearest(spark.createDataFrame([(0, [1.0, 0.0])], schema), 20, 5).count() == 0
    got = nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], schema), 20, 5).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 1.0), (1, 0.5)]


def test_a_far_vector_hides_no_inner_products(spark):
    """One vector is 5000 times as long as the others; vectors of another length take no part."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= 5000
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, [1.0, 2.0]), (1020, [1.0] * 17)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 10, shard_vectors=250).collect()
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    best = {i: set(np.argsort(-score[i])[:10].tolist()) for i in range(0, 600, 20)}
    found = sum(r["vec_id"] in best[r["query_id"]] for r in got)
    assert {r["query_id"] for r in got} == set(best) and found >= 0.95 * 10 * len(best)
