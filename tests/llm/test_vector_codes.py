"""Vector codes against plain rounds over all entries, in Python's own integers."""

import hashlib

import numpy as np
import pytest

from threadlake.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, error string, code string, part string"


def plain(rows, scale, entries, rounds):
    kept = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v], lab) for i, v, lab in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    n = len(kept[0][1]) // 4
    books = [[r[1][p * n : (p + 1) * n] for r in kept[:entries]] for p in range(4)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), j) for j, e in enumerate(books[p]))

    def assigned():
        return [[nearest(p, v[p * n : (p + 1) * n]) for p in range(4)] for _, v, _ in kept]

    for _ in range(rounds):
        found = assigned()
        for p in range(4):
            for j in range(len(books[p])):
                own = [r[1][p * n : (p + 1) * n] for r, f in zip(kept, found, strict=True) if f[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in assigned()]
    by = {}
    for r, e in zip(kept, errors, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    return sorted(((r[0] is None, r[0] or 0, "".join(f"{j:02x}" for _, j in f), e, by[r[2]], sha) for r, f, e in zip(kept, assigned(), errors, strict=True)))


def rows_of(seed, n, width=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (9, width))
    rows = [(int(i), (centres[rng.integers(9)] + rng.normal(0, 0.1, width)).astype(np.float32).tolist(), int(rng.integers(4))) for i in rng.permutation(n)]
    rows += [(1, rows[0][1], None), (None, rows[1][1], 2), (None, None, 1), (n + 1, None, 1), (n + 2, [None] * width, 1), (n + 3, [float("nan")] * width, 0), (n + 4, [float("inf")] + [0.0] * (width - 1), 0)]
    return rows + [rows[5], rows[5]] + [(n + 10 + i, rows[7][1], 3) for i in range(200)] + [(n + 300, [0.0] * width, None)]


@pytest.mark.parametrize(("seed", "n", "entries", "rounds"), [(1, 60, 16, 4), (2, 300, 40, 3), (3, 10, 256, 4), (4, 500, 256, 2)])
def test_equals_plain_rounds(spark, seed, n, entries, rounds):
    rows = rows_of(seed, n)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(5)
    got = sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.compress(df, 1024, rounds, entries).collect())
    assert got == plain(rows, 1024, entries, rounds)


def test_search_is_exact_with_ties_and_large_values():
    rng = np.random.default_rng(5)
    for high in (3, 1000, 1 << 21):
        e = rng.integers(-high, high, (50, 6))
        e[17] = e[3]
        x = np.concatenate([rng.integers(-high, high, (400, 6)), e, (e[:-1] + e[1:]) // 2])
        d = ((x[:, None, :] - e[None, :, :]) ** 2).sum(axis=2)
        found, least = codes.Codebook(e).nearest(x, rng.integers(0, 50, len(x)))
        assert (found == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()


def test_empty_and_unusable_tables(spark):
    for rows in ([], [(1, None, 2, "x", "y", "z"), (2, [float("nan")] * 4, 1, None, None, None)]):
        assert codes.compress(spark.createDataFrame(rows, SCHEMA)).collect() == []
