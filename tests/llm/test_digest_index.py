import hashlib
import uuid
from collections import defaultdict

from tests.llm.common import cases, frame
from threadlake.llm.digest_index import DigestIndex, dedup, digests_of, fresh_index

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_one_batch(spark):
    groups = defaultdict(list)
    for d, t, *_ in cases():
        groups[hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()].append(d)
    got = dedup(frame(spark), fresh_index(spark)).collect()
    assert len(got) == len(cases())
    for r in got:
        ids = groups[r["text_sha256"]]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)


def test_later_batches_meet_the_index(spark):
    index = DigestIndex(spark, "i_" + uuid.uuid4().hex, buckets=3)
    rows = cases()
    dedup(frame(spark, rows[:10]), index).collect()
    assert index.read().count() == 10
    second = dedup(frame(spark, [(100, rows[0][1].upper(), *[None] * 11), (101, "new text", *[None] * 11)]), index).collect()
    assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in second} == {100: (0, False), 101: (101, True)}
    assert index.read().count() == 11
    assert dedup(frame(spark, rows[:12]), index).where("kept").count() == 2
    assert index.read().count() == 13


def test_any_number_of_batches_gives_the_same(spark):
    want = None
    for n in (1, 2, 5):
        index = fresh_index(spark)
        got = sorted(map(str, dedup(frame(spark), index, n).collect()))
        assert index.read().count() == index.read().select("digest").distinct().count()
        assert want is None or got == want
        want = got


def test_a_batch_that_is_added_again_changes_nothing(spark):
    index = fresh_index(spark)
    batch = digests_of(frame(spark)).groupBy("digest").agg({"doc_id": "max"}).toDF("digest", "keep_id")
    index.add(batch, "run")
    before = sorted(map(str, index.read().collect()))
    index.add(batch, "run")
    assert sorted(map(str, index.read().collect())) == before


def test_the_index_side_is_not_shuffled(spark):
    index = fresh_index(spark)
    dedup(frame(spark), index).collect()
    old = index.read().select("digest").hint("merge")
    plan = frame(spark).selectExpr("sha2(text, 256) digest").selectExpr("unhex(digest) digest").join(old, "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and text.count("Exchange hashpartitioning") == 1


def test_empty(spark):
    assert dedup(frame(spark, []), fresh_index(spark)).count() == 0
