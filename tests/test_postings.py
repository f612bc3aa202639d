"""The stored index: SQLite's scores over all fields, skipped blocks, batches, removals, many queries at once."""

import random
import sqlite3
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from threadlake.operators import fts, postings, rank, store
from threadlake.storage import written

from .test_search import frame, memory

KINDS = ("event", "session_summary")
SCHEMA = postings.ATTRIBUTES + ", fields array<string>"


def docs_of(seed, n, longest=30):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Über", "uber", "beta-gamma", "x_y", "naïve"]
    text = lambda most: " ".join(rng.choice(words) for _ in range(rng.randint(0, most)))
    rows = []
    for i in range(n):
        fields = [f"s{i % 7}", rng.choice(["/w/alpha", "/w/b"]), rng.choice(["", "/r/beta"]), rng.choice(["Stop", "Note"]), text(longest if i % 10 else 10 * longest)]
        rows.append((KINDS[i % 3 == 0], f"k{i}", f"s{i % 7}", f"2026-01-{i % 28 + 1:02d}", i % 2, 0, 0, True, fields[4], fields))
    return rows


def sqlite_of(rows, kind):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(key unindexed, a, b, c, d, e)")
    con.executemany("insert into t values (?, ?, ?, ?, ?, ?)", [(r[1], *r[9]) for r in rows if r[0] == kind])
    return con


def asked_of(spark, *queries):
    return written(postings.parse(spark.createDataFrame(list(enumerate(queries)), "qid long, query string")), "asked")


def wanted_scores(con, query, every):
    phrases = fts.strict_phrases(query) if every else fts.relaxed_phrases(query)
    if not phrases:
        return {}
    match = (" AND " if every else " OR ").join('"' + " ".join(p) + '"' for p in phrases)
    return {r[0]: -r[1] for r in con.execute("select key, bm25(t) from t where t match ?", (match,))}


QUERIES = ["alpha", "beta-gamma delta", "über /w/alpha", "alpha none", "s3 Stop gamma", "beta-gamma-alpha x_y", ""]


def same(index, spark, rows):
    asked = asked_of(spark, *QUERIES)
    names = {(r.kind, r.doc): r.key for r in index.documents().collect()}
    for every in (True, False):
        got = {}
        for r in index.scores(asked.where(F.col("every") == every)).collect():
            got.setdefault((r.qid, r.kind), {})[names[r.kind, r.doc]] = r.gain
        for kind in KINDS:
            con = sqlite_of(rows, kind)
            for qid, query in enumerate(QUERIES):
                want, own = wanted_scores(con, query, every), got.get((qid, kind), {})
                assert own.keys() == want.keys(), (query, every)
                assert all(abs(own[k] - want[k]) < 1e-6 for k in want)


def test_scores_over_all_fields_are_those_of_sqlite(spark, tmp_path):
    rows = docs_of(1, 300)
    index = postings.Index(spark, f"file://{tmp_path}/i")
    index.add(spark.createDataFrame(rows, SCHEMA))
    same(index, spark, rows)


def test_batches_removals_and_compaction_keep_scores(spark, tmp_path):
    rows = docs_of(2, 200)
    index = postings.Index(spark, f"file://{tmp_path}/i", 4)
    index.add(spark.createDataFrame(rows[:150], SCHEMA))
    index.add(spark.createDataFrame(rows[100:], SCHEMA))  # fifty are there already
    gone = spark.createDataFrame([(r[0], r[1]) for r in rows[::4]], "kind string, key string")
    index.remove(gone)
    left = [r for i, r in enumerate(rows) if i % 4]
    back = rows[0][:8] + ("alpha again", ["s", "w", "", "Note", "alpha again"])
    index.add(spark.createDataFrame([back], SCHEMA))
    same(postings.Index(spark, index.path, 4), spark, [*left, back])  # read anew
    same(index.compact(), spark, [*left, back])


def test_what_a_lost_writer_left_is_not_read(spark, tmp_path):
    rows = docs_of(3, 60)
    index = postings.Index(spark, f"file://{tmp_path}/i")
    index.add(spark.createDataFrame(rows[:40], SCHEMA))
    commit, index._commit = index._commit, lambda *a: None
    index.add(spark.createDataFrame(rows[40:], SCHEMA))
    index._commit = commit
    assert index.documents().count() == 40
    index.add(spark.createDataFrame(rows[40:], SCHEMA))
    same(index, spark, rows)


def test_the_best_are_found_without_all_blocks(spark, tmp_path, k=5):
    rng = random.Random(7)
    rows = [("event", f"k{i}", f"s{i // 400}", f"2026-{i % 12 + 1:02d}", 0, 0, 0, True, "", [" ".join(["alpha"] * rng.choice([0, 0, 0, 0, 1, 9 if i // 400 == 3 else 1]) + ["beta"] * (i % 5 == 0) + ["filler"] * rng.randint(5, 60))]) for i in range(4000)]
    index = postings.Index(spark, f"file://{tmp_path}/i")
    index.add(spark.createDataFrame(rows, SCHEMA).repartition(3))
    asked = asked_of(spark, "alpha", "alpha beta")
    for tier in ("every", "not every"):
        own = written(asked.where(tier), "own")
        got = index.best(own, k, first_blocks=2).collect()
        every = index.scores(own).join(index.documents().select("doc", "key", "depth", "at"), "doc").collect()
        for qid in {r.qid for r in every}:
            want = sorted(((-r.gain, -r.depth, [-ord(c) for c in r["at"]], r.key) for r in every if r.qid == qid))[:k]
            assert [(r.key, -r.gain) for r in sorted(got, key=lambda r: r.place) if r.qid == qid] == [(w[3], w[0]) for w in want]
        if tier == "every":
            assert index.read_blocks < 0.7 * index.all_blocks


def test_filters_choose_before_the_best_are_taken(spark, tmp_path):
    rows = docs_of(4, 300)
    index = postings.Index(spark, f"file://{tmp_path}/i")
    index.add(spark.createDataFrame(rows, SCHEMA))
    asked = asked_of(spark, "alpha").where("every")
    some = spark.createDataFrame([("s2",), ("s5",)], "session_id string")
    scores = wanted_scores(sqlite_of(rows, "event"), "alpha", True)
    own = sorted((-round(v, 9) for k, v in scores.items() if k in {r[1] for r in rows if r[2] in ("s2", "s5")}))[:5]
    got = [r for r in index.best(asked, 5, some, "event", 1).orderBy("place").collect()]
    assert {r.session_id for r in got} <= {"s2", "s5"} and [round(-r.gain, 6) for r in got] == [round(s, 6) for s in own]


def test_search_by_the_index_equals_search_by_scan(spark, tmp_path):
    rng = random.Random(8)
    words = ["rollout", "plan", "retry", "budget", "deploy-key", "cache", "v2", "42", "latency"]
    rows = [(f"s{rng.randint(0, 11)}", rng.choice(["UserPromptSubmit", "Stop", "Note"]), " ".join(rng.choices(words, k=rng.randint(2, 12)))) for _ in range(160)]
    m = memory(frame(spark, rows))
    index = postings.Index(spark, f"file://{tmp_path}/i")
    index.add(rank.index_rows(m.events, m.nodes, m.summaries))
    queries = ["rollout plan", "retry zebra budget", "deploy-key", "42 latency", "zebra", "cache v2 plan budget", "!?"]
    more = [{}, {"exclude": ("s1", "s4")}, {"cwd": m.sessions.first()["cwd"]}, {"limit": 2}, {}, {}]
    for query, options in list(zip(queries, more))[:4]:
        args = (m.events, m.nodes, m.summaries, m.sessions, query)
        assert rank.search(*args, **options, index=index).collect() == rank.search(*args, **options).collect(), (query, options)
    for query in queries[1:3]:
        assert rank.search_nodes(m.nodes, query, 3, index=index).collect() == rank.search_nodes(m.nodes, query, 3).collect()
        assert rank.search_events(m.events, query, 3, index=index).collect() == rank.search_events(m.events, query, 3).collect()
    many = rank.search_many(index, m.sessions, spark.createDataFrame(list(enumerate(queries)), "qid long, query string"), 5).collect()
    for qid, query in enumerate(queries):
        one = rank.search(m.events, m.nodes, m.summaries, m.sessions, query, 5).collect()
        assert [(r.session_id, r.discovery_score) for r in sorted(many, key=lambda r: r["rank"]) if r.qid == qid] == [(r.session_id, r.discovery_score) for r in one]


def test_an_empty_index_finds_nothing(spark, tmp_path):
    index = postings.Index(spark, f"file://{tmp_path}/i")
    assert index.best(asked_of(spark, "alpha"), 5).count() == 0
    index.add(spark.createDataFrame([], SCHEMA))
    assert index.best(asked_of(spark, "alpha"), 5).count() == 0
    index.add(spark.createDataFrame([("event", "k", "s", "t", 0, 0, 0, True, None, ["", ""])], SCHEMA))
    assert index.best(asked_of(spark, "alpha"), 5).count() == 0 and index.sizes == {"event": (1, 0)}


def test_terms_of_a_block_have_their_places_by_field_and_each_block_once(spark, tmp_path):
    # Blocks of 128 documents, some of them blank, of two kinds that share a block; places leave one free after each field.
    rows = [("event" if i < 150 else "summary_node", f"k{i:03}", "s", f"{i:03}", 0, 0, 0, True, "", ["b a b", "", f"a t{i % 7}"] if i % 10 else ["", "", ""]) for i in range(300)]
    index = postings.Index(spark, f"file://{tmp_path}/i")
    index.add(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    held = index._read("postings", postings._POSTINGS).collect()
    assert len({(r.kind, r.term, r.block) for r in held}) == len(held)
    names = {r.doc: (r.kind, r.key) for r in index.documents().collect()}
    got = {(*names[d.doc], r.term): d.positions for r in held for d in r.docs}
    want = {}
    for kind, key, *_, fields in rows:
        flat = [t for f in fields for t in [*f.split(), ""]]
        want |= {(kind, key, t): [i for i, x in enumerate(flat) if x == t] for t in set(flat) - {""}}
    assert got == want
    for r in held:
        assert r.block == r.docs[0].doc >> postings.BLOCK_BITS and [d.doc for d in r.docs] == sorted(d.doc for d in r.docs)
        assert (r.n, r.most, r.least) == (len(r.docs), max(len(d.positions) for d in r.docs), min(d.dl for d in r.docs))
        assert {names[d.doc][0] for d in r.docs} == {r.kind}


def test_a_block_splits_texts_of_tokens_and_takes_marks_off():
    block = pa.table({"kind": ["event"] * 2, "doc": pa.array([0, 1], pa.int64()), "dl": pa.array([3, 1], pa.int32()), "tokens": [["über a", "", "uber"], ["a"]], "block": pa.array([0, 0], pa.int64())})
    got = {r["term"]: [(d["doc"], d["positions"]) for d in r["docs"]] for r in postings._block(block).to_pylist()}
    assert got == {"uber": [(0, [0, 4])], "a": [(0, [1]), (1, [0])]}


def test_many_queries_are_put_to_ranges_and_not_each_to_its_postings(spark, tmp_path, monkeypatch, k=5):
    rows = docs_of(5, 300) + [("event", f"same{i:03}", "s1", f"2026-02-{i % 3 + 1:02d}", 0, 0, 0, True, "", ["s1", "", "", "Stop", "gamma twin twin"]) for i in range(40)]
    index = postings.Index(spark, f"file://{tmp_path}/i")
    index.add(spark.createDataFrame(rows[:200], SCHEMA))
    index.add(spark.createDataFrame(rows[200:], SCHEMA))
    index.remove(spark.createDataFrame([(r[0], r[1]) for r in rows[::7]], "kind string, key string"))
    asked, some = asked_of(spark, *QUERIES, "twin", "twin gamma", "gamma alpha-beta none"), spark.createDataFrame([("s1",), ("s5",)], "session_id string")
    names = ["qid", "kind", "key", "gain", "place", "session_id", "at", "depth"]
    own = lambda tier, **more: sorted(index.best(asked.where(tier), k, **more).select(*names).collect())
    want = [own("every"), own("not every", wanted=some, kind="event")]
    assert len(want[0]) > 30 and len(want[1]) > 10
    monkeypatch.setattr(postings, "MANY", 1)
    monkeypatch.setattr(postings, "RANGE_BITS", 7)
    read, hits = [], index._hits
    monkeypatch.setattr(index, "_hits", lambda asked, blocks, kind: read.append({r.length for r in asked.select("length").collect()}) or hits(asked, blocks, kind))
    monkeypatch.setattr(index, "_scored", None)
    assert [own("every"), own("not every", wanted=some, kind="event")] == want
    assert all(min(lengths) > 1 for lengths in read)  # places are read for phrases alone


def test_a_batch_is_made_in_slices_and_leaves_nothing_else(spark, tmp_path, monkeypatch):
    own, puts = postings.put, []
    monkeypatch.setattr(postings, "put", lambda df, path, *by, **options: puts.append(path) or own(df, path, *by, **options))
    monkeypatch.setattr(postings, "SLICE_TOKENS", 300)
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    files = lambda: {f for f in shared.rglob("*.parquet")}
    rows = docs_of(9, 400)
    docs = written(spark.createDataFrame(rows, SCHEMA), "docs")
    index, before = postings.Index(spark, f"file://{tmp_path}/i", 4), files()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        index.add(docs.where("key < 'k3'"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum("/postings/" in p for p in puts) > 1 and files() == before
    index.add(docs)
    same(index, spark, rows)
    held = store.Store(spark, f"file://{tmp_path}/m", 2)
    events = written(frame(spark, [(f"s{i % 3}", "Note", f"long text {i} of a session") for i in range(40)]), "events")
    before = files()
    held.ingest(events.where("seq % 2 = 0"))
    held.ingest(events)
    assert files() == before and held.memory().events.count() == 40
    (texts,) = {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/m/index/documents").where("kind = 'event'").selectExpr("size(filter(fields, t -> t = said))").collect()}
    assert texts == (0,)  # a text is stored once
