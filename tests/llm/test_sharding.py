import zlib
from collections import defaultdict

import numpy as np

from tests.llm.common import cases, frame
from threadlake.llm.sharding import assign_shards, difference


def test_difference_is_a_partition_and_tight():
    rng = np.random.default_rng(1)
    items = rng.integers(1, 1000, 300)
    parts = np.zeros((300, 7), np.int64)
    parts[:, 0] = items
    sums, label = difference(parts)
    got = np.bincount(label[:, 0], weights=items, minlength=7)
    assert sorted(got) == sorted(sums)
    assert got.max() - got.min() <= 2


def test_groups_stay_together_and_slots_have_no_gap(spark):
    for block, fan in ((20_000, 512), (4, 2)):
        rows = assign_shards(frame(spark), 5, block_groups=block, fan_in=fan, slot_rows=7).collect()
        want = sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in cases())
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
        shard_of, slots = defaultdict(set), defaultdict(list)
        for r in rows:
            shard_of[r["size"], r["text_crc32"]].add(r["shard"])
            slots[r["shard"]].append(r["slot"])
            assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 5
        assert all(len(s) == 1 for s in shard_of.values())
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_bytes_are_near_equal(spark):
    rows = [(i, "w" * (100 + (i * 7919) % 1000), None, None, None, *[None] * 8) for i in range(2000)]
    got = defaultdict(int)
    for r in assign_shards(frame(spark, rows), 8, block_groups=300, fan_in=3).collect():
        got[r["shard"]] += r["size"]
    assert len(got) == 8 and max(got.values()) - min(got.values()) < 0.01 * max(got.values())


def test_empty(spark):
    assert assign_shards(frame(spark, []), 4).count() == 0
