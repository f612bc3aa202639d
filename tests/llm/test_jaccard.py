import random
import re
from itertools import combinations

import numpy as np
import pandas as pd

from tests.llm.common import cases, frame, prose
from threadlake.llm import jaccard
from threadlake.llm.jaccard import least_matches, near_duplicates


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def grams(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def by_force(rows):
    """doc_id -> (class, links, text links) over rows with an id."""
    rows = [(d, tuple(words(t))) for d, t in rows if d is not None]
    sets = [grams(w) for _, w in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    texts = [set() for _ in rows]
    for i, j in combinations(range(len(rows)), 2):
        same = rows[i][1] == rows[j][1] and rows[i][1]
        union = len(sets[i] | sets[j])
        if same or union and len(sets[i] & sets[j]) >= 0.8 * union:
            links[i] += 1
            links[j] += 1
            if not same:
                texts[i].add(rows[j][1])
                texts[j].add(rows[i][1])
            root[find(j)] = find(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, low[find(i)], links[i], len(texts[i])) for i, (d, _) in enumerate(rows))


def check(spark, rows):
    got = near_duplicates(frame(spark, rows)).where("doc_id is not null")
    got = sorted((r["doc_id"], r["class_id"], r["n_links"], r["n_text_links"]) for r in got.collect())
    assert got == by_force([r[:2] for r in rows])


def test_awkward_cases(spark):
    rows = [r for r in cases() if not (r[0] == 5 and r[1].startswith("other"))]
    check(spark, rows)
    assert near_duplicates(frame(spark)).count() == len(cases())
    assert near_duplicates(frame(spark, [])).count() == 0


def test_families_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(jaccard, "VERIFY_BLOCK", 6)
    rng = random.Random(3)
    rows = []
    for _ in range(4):
        base = prose(rng, 120).split()
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = prose(rng, 1)
            rows.append((len(rows), " ".join(own), *[None] * 11))
    rows += [(200 + i, rows[i][1], *[None] * 11) for i in range(0, 30, 3)]
    check(spark, rows)


def test_two_blocks_of_one_family_give_one_pair():
    sig = np.arange(jaccard.BANDS * jaccard.ROWS, dtype="<u2").tobytes()
    two = pd.DataFrame({"bucket": 1, "i": 0, "j": 1, "side": [0] * 30 + [1] * 20, "doc": range(50), "sig": sig})
    run = jaccard._prune(0.8, 1e-6)
    assert sum(len(p) for p in run(iter([two]))) == 1
    assert sum(len(p) for p in run(iter([two[:30].assign(j=0)]))) == 29


def test_least_matches_follow_the_posterior():
    table = least_matches(0.8, 1e-6, 24, 240)
    grid = np.linspace(0, 1, 20_001)
    for n, m in table.items():
        for k, kept in ((m, True), (m - 1, False)):
            like = grid**k * (1 - grid) ** (n - k)
            mass = like[grid >= 0.8].sum() / like.sum()
            assert (mass >= 1e-6 * 0.9) == kept or abs(mass - 1e-6) < 2e-7
