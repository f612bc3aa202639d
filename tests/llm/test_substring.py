import hashlib
import random
import re

from tests.llm.common import cases, frame, prose
from threadlake.llm.substring import lengths, remove_repeats, repeated_spans


def by_force(rows, window=13):
    rows = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    low = {}
    for d, w in rows:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                low[k] = min(low.get(k, d), d)
    out = []
    for d, w in rows:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if low[tuple(w[i : i + window])] < d:
                    gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((-1 if d is None else d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(df, window=13):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(df, window).collect())


def test_same_as_brute_force(spark):
    assert got(frame(spark)) == by_force([r[:2] for r in cases()])
    assert remove_repeats(frame(spark, [])).count() == 0


def test_many_overlapping_passages(spark):
    rng = random.Random(9)
    parts = [prose(rng, rng.randint(5, 30)) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 6))), *[None] * 11) for i in range(150)]
    rows += [(200 + i, "a b " * rng.randint(5, 20), *[None] * 11) for i in range(10)]
    for window in (40, 13, 6, 2):
        assert got(frame(spark, rows), window) == by_force([r[:2] for r in rows], window)


def test_lengths_double_to_the_window():
    assert lengths(13) == [7, 13] and lengths(50) == [7, 13, 25, 50] and lengths(5) == [5]
    for w in range(1, 300):
        steps = lengths(w)
        assert steps[-1] == w and steps[0] < 8 and all(a < b <= 2 * a for a, b in zip(steps, steps[1:]))


def test_levels_end_when_nothing_repeats(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 90), *[None] * 11) for i in range(20)]
    assert repeated_spans(frame(spark, rows), 60).count() == 0
    assert got(frame(spark, rows), 60) == by_force([r[:2] for r in rows], 60)


def test_windows_meet_over_many_small_batches(spark):
    """One passage in a third of the documents, one document that repeats a passage, batches of a few rows."""
    rng = random.Random(12)
    passage, other = prose(rng, 20), prose(rng, 15)
    texts = [prose(rng, 25) + (" " + passage if i % 3 == 0 else "") for i in range(120)]
    texts += [" ".join([other, prose(rng, 3)] * 12), other + " " + prose(rng, 5), texts[5], texts[5]]
    rows = [(i, t, *[None] * 11) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for n in ("1", "7"):
            spark.conf.set(name, n)
            assert got(frame(spark, rows)) == by_force([r[:2] for r in rows])
    finally:
        spark.conf.set(name, before)
