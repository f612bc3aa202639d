"""The stored memory: batches in any order end in the tree, sessions, summaries and scores of one build."""

import random

from pyspark.sql import functions as F

from threadlake import storage
from threadlake.operators import ordering, rank, store, summaries, upkeep
from threadlake.storage import written

from .test_search import frame, memory

WORDS = ["rollout", "plan", "retry", "budget", "deploy-key", "cache", "v2", "latency", "queue", "broker"]


def events_of(spark, n, seed=1):
    rng = random.Random(seed)
    # One session has most of the events: its tree has several levels.
    rows = [("big" if rng.random() < 0.8 else f"s{rng.randint(0, 4)}", rng.choice(["UserPromptSubmit", "Stop", "Note"]), " ".join(rng.choices(WORDS, k=rng.randint(2, 9))) + f" {i}") for i in range(n)]
    return written(frame(spark, rows), "events")


def rows_of(df, key):
    return sorted((r.asDict(recursive=True) for r in df.select(*sorted(df.columns)).collect()), key=lambda r: r[key])


def test_late_events_give_the_tree_of_a_rebuild(spark, tmp_path):
    events = events_of(spark, 330)
    held = store.Store(spark, f"file://{tmp_path}/s", 4)
    place = F.pmod(F.xxhash64("event_id"), F.lit(40))
    late = (events.seq == events.agg(F.max("seq")).first()[0] - 20) | (events.seq == 150)
    parts = [events.where(~late & (place > 3)), events.where(~late & (place <= 3)), events.where(late)]
    counts = [held.ingest(p) for p in parts]
    assert held.ingest(events.where("seq % 5 = 0")) == {"events": 0, "sessions": 0, "nodes": 0, "removed_nodes": 0}
    m, whole = store.Store(spark, held.path, 4).memory(), memory(events)
    assert rows_of(m.nodes, "node_id") == rows_of(whole.nodes, "node_id")
    assert rows_of(m.sessions, "session_id") == rows_of(whole.sessions, "session_id")
    assert rows_of(m.summaries, "session_id") == rows_of(whole.summaries, "session_id")
    assert sorted(r.event_id for r in m.events.select("event_id").collect()) == sorted(r.event_id for r in events.select("event_id").collect())
    assert counts[2]["events"] <= 2 and counts[0]["nodes"] > 40
    for query in ("rollout plan", "retry zebra"):
        args = (whole.events, whole.nodes, whole.summaries, whole.sessions, query, 3)
        assert rank.search(*args, index=m.index).collect() == rank.search(*args).collect()


def test_an_event_at_the_end_renews_one_path(spark, tmp_path):
    events = written(events_of(spark, 400, 3).where("session_id = 'big'"), "big")
    last = events.agg(F.max("ts")).first()[0]
    held = store.Store(spark, f"file://{tmp_path}/s", 2)
    first = held.ingest(events.where(F.col("ts") < last))
    more = held.ingest(events.where(F.col("ts") == last))
    assert first["nodes"] > 40 and more["nodes"] <= 5 and more["removed_nodes"] <= 5
    assert rows_of(held.memory().nodes, "node_id") == rows_of(summaries.dag(events), "node_id")


def test_changed_places_are_found_by_keys(spark):
    events = events_of(spark, 120, 5)
    fresh = events.where("seq in (17, 90)")
    got = {r.session_id: r.chunk for r in summaries.changed_from(events, fresh).collect()}
    want = {}
    for s in {r.session_id for r in fresh.collect()}:
        own = [r.event_id for r in events.where(F.col("session_id") == s).orderBy("ts", "seq").collect()]
        want[s] = min(own.index(r.event_id) for r in fresh.where(F.col("session_id") == s).collect()) // 8
    assert got == want


def test_one_session_with_most_events_is_many_tasks(spark):
    """Sums, places and predecessors over a hot key, dealt to many ranges, equal plain loops."""
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.9 else f"s{i % 5}", i, rng.randint(0, 9)) for i in range(3000)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame(rows, "k string, o long, v long")
        out = ordering.ordered(df, "k", [F.desc("o")], "at", {"before": "v"}, {"was": "o"})
        tasks = out.where("k = 'hot'").select(F.spark_partition_id()).distinct().count()
        got = {(r.k, r.o): (r["at"], r.before, r.was) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = {}
    for k in {r[0] for r in rows}:
        total, was = 0, None
        for i, (_, o, v) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: -r[1])):
            want[k, o] = (i, total, was)
            total, was = total + v, o
    assert got == want and tasks > 1


def test_overflow_search_is_newest_first_within_its_budget(spark):
    texts = ["has Token here", "none", "x" * 40 + "token", "é token", "token late"]
    rows = [(f"e{i}", "s", f"2026-01-0{i + 1}", i, "/w" if i % 2 else "/v", None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "event_id string, session_id string, ts string, seq long, cwd string, repo_root string, text string")
    ids = lambda **k: [r.event_id for r in upkeep.overflow_search(df, "token", **k).collect()]
    assert ids() == ["e4", "e3", "e2", "e0"] and ids(limit=2) == ["e4", "e3"] and ids(cwd="/w") == ["e3"]
    assert ids(most_bytes=18) == ["e4", "e3"] and ids(most_bytes=17) == ["e4"] and ids(most_bytes=4) == []
    assert upkeep.overflow_search(df, "token", 9).where("event_id = 'e3'").first()["byte_offset"] == 3


def test_scratch_is_deleted(spark):
    at = storage.shared_dir(spark)
    df = storage.written(spark.range(3))
    assert df.count() == 3 and storage.exists(spark, at.rsplit("/", 1)[0])
    storage.clear(spark)
    assert not storage.exists(spark, at.rsplit("/", 1)[0])
    assert storage.written(spark.range(2)).count() == 2


def test_expired_events_leave_the_index_and_later_ones_rebuild_their_session(spark, tmp_path):
    events = events_of(spark, 150, 8)
    late = events.where("seq >= 140")
    held = store.Store(spark, f"file://{tmp_path}/s", 2)
    held.ingest(events.where("seq < 140"))
    before, nodes = "2026-01-01T00:01:20.000Z", held.memory().nodes.count()
    gone = held.expire(before, 300)
    stay = upkeep.expire(events.where("seq < 140"), upkeep.segments(events.where("seq < 140"), 300), before)
    ids = sorted(r.event_id for r in stay.collect())
    m = store.Store(spark, held.path, 2).memory()
    assert gone == 140 - len(ids) > 0 and sorted(r.event_id for r in m.events.collect()) == ids
    assert m.index.sizes["event"][0] == len(ids) and m.nodes.count() == nodes and held.expire(before, 300) == 0
    assert sorted(r.key for r in m.index.documents().where("kind = 'event'").collect()) == ids
    held.ingest(late)
    whole = written(stay.select(*events.columns).unionByName(late), "whole")
    touched = {r.session_id for r in late.collect()}
    own = lambda nodes: sorted(r.node_id for r in nodes.collect() if r.session_id in touched)
    assert own(held.memory().nodes) == own(summaries.dag(whole))


def test_the_log_alone_is_searched_without_an_index(spark):
    events = frame(spark, [("a", "Note", "Retry budget"), ("b", "Stop", "nothing"), ("c", "Note", "the budget-plan"), ("c", "Note", "retry"), ("d", "Note", "plan", "/retry")])
    found = lambda *a, **k: [(r.session_id, r.event_count) for r in rank.search_log(events, *a, **k).collect()]
    assert found("retry") == [("d", 1), ("c", 1), ("a", 1)] and found("retry plan", limit=2) == [("d", 1), ("c", 2)]
    assert found("retry", cwd="/w") == [("c", 1), ("a", 1)] and found("retry", exclude=("d", "a")) == [("c", 1)] and found("zebra") == []


def test_what_is_of_an_older_version_is_made_again(spark, tmp_path, monkeypatch):
    events = events_of(spark, 60, 7)
    held = store.Store(spark, f"file://{tmp_path}/s", 4)
    monkeypatch.setattr(summaries, "SUMMARY_VERSION", summaries.SUMMARY_VERSION - 1)
    held.ingest(events.where("session_id <> 's1'"))
    monkeypatch.undo()
    held.ingest(events.where("session_id = 's1'"))
    old = held.memory().summaries.select("session_id").where("session_id <> 's1'").count()
    assert held.clean_up(1) == 1 and held.clean_up() == old - 1 and held.clean_up() == 0
    m, whole = store.Store(spark, held.path, 4).memory(), memory(events)
    assert rows_of(m.summaries, "session_id") == rows_of(whole.summaries, "session_id")
    assert rows_of(m.nodes, "node_id") == rows_of(whole.nodes, "node_id")
    assert rows_of(m.sessions, "session_id") == rows_of(whole.sessions, "session_id")
    assert held.forget(events.where("false")) == 0 and held.forget(spark.createDataFrame([("zz", "s1")], "event_id string, session_id string")) == 0


def test_a_store_that_is_indexed_later_has_its_tree_at_once_and_is_then_searched_like_any(spark, tmp_path):
    events = events_of(spark, 150, 11)
    held = store.Store(spark, f"file://{tmp_path}/s", 2, indexed=False)
    held.ingest(events.where("seq % 3 > 0"))
    held.ingest(events.where("seq % 3 = 0").unionByName(events.where("seq % 6 = 0")))
    whole = memory(events)
    assert held.index.sizes == {} and rows_of(held.memory().nodes, "node_id") == rows_of(whole.nodes, "node_id")
    for _ in range(2):
        held.index_all()
        assert held.index.sizes["event"][0] == events.count() and held.index.sizes["summary_node"][0] == whole.nodes.count()
    args = (whole.events, whole.nodes, whole.summaries, whole.sessions, "rollout plan", 3)
    assert rank.search(*args, index=held.index).collect() == rank.search(*args).collect()


def test_rows_without_repeated_keys_stay_as_they_are(spark):
    rows = written(spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string"), "rows")
    assert storage.unique(rows, "k") is rows
    assert storage.unique(rows.union(rows), "k").count() == 3
