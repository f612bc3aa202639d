"""Search and contexts: BM25 against SQLite's own index, ranking cases, packing within budgets, the recovery stream."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from threadlake.functions import args
from threadlake.functions import text as tx
from threadlake.operators import context, fts, graph, ordering, rank, sessions, summaries, upkeep
from threadlake.storage import written
from threadlake.streaming import ingest

EVENT = "event_id string, session_id string, ts string, seq long, hook_event string, cwd string, repo_root string, parent_session_id string, tool_name string, turn_id string, tool_use_id string, text string, tokens long"


def frame(spark, rows):
    """Events of (session, hook, text[, cwd])."""
    out = []
    for i, (session, hook, text, *cwd) in enumerate(rows):
        out.append((f"e{i:03d}", session, f"2026-01-01T00:{i // 60:02d}:{i % 60:02d}.000Z", i, hook, cwd[0] if cwd else "/w", None, None, None, None, None, text, 1))
    return spark.createDataFrame(out, EVENT)


def memory(events):
    events = written(events)
    return context.Memory(events, written(sessions.rollup(events)), written(summaries.dag(events)), written(summaries.session_summaries(events)))


@pytest.mark.parametrize("query", ["alpha", "alpha beta", "beta-gamma delta", "über alpha", "none"])
def test_scores_are_those_of_sqlite(spark, query):
    rng = random.Random(len(query))
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Über", "uber", "beta-gamma", "x_y"]) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(c)")
    con.executemany("insert into t(rowid, c) values (?, ?)", list(enumerate(texts)))
    docs = spark.createDataFrame([(str(i), "s", t, "x") for i, t in enumerate(texts)], "key string, session_id string, text string, at string")
    m = rank.Matches(docs, query, ["key"])
    for every, glue in ((True, " AND "), (False, " OR ")):
        phrases = fts.strict_phrases(query) if every else fts.relaxed_phrases(query)
        if not phrases:
            assert m.tier(every).count() == 0
            continue
        match = glue.join('"' + " ".join(p) + '"' for p in phrases)
        want = {str(r[0]): r[1] for r in con.execute("select rowid, bm25(t) from t where t match ?", (match,))}
        got = {r["key"]: r["score"] for r in m.tier(every).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_sessions_with_more_evidence_come_first(spark):
    rows = [("big", "UserPromptSubmit" if i % 2 else "Stop", f"rollout plan retry budget step {i}") for i in range(12)] + [("tiny", "UserPromptSubmit", "rollout plan retry budget once")]
    rows += [("other", "Note", "nothing of that kind")]
    m = memory(frame(spark, rows))
    got = rank.search(m.events, m.nodes, m.summaries, m.sessions, "rollout plan retry budget").collect()
    assert [r["session_id"] for r in got] == ["big", "tiny"] and got[0]["confidence"] == "high" and "tiny session penalty" in got[1]["reasons"]
    assert "retry budget" in got[0]["snippet"]
    loose = rank.search(m.events, m.nodes, m.summaries, m.sessions, "rollout zebra").collect()
    assert {r["session_id"] for r in loose} == {"big", "tiny"}
    assert rank.search(m.events, m.nodes, m.summaries, m.sessions, "zebra").count() == 0
    assert [r["session_id"] for r in rank.search(m.events, m.nodes, m.summaries, m.sessions, "rollout", exclude=("big",)).collect()] == ["tiny"]
    assert rank.search(m.events, m.nodes, m.summaries, m.sessions, "rollout", cwd="/elsewhere").count() == 0
    assert rank.search(m.events, m.nodes, m.summaries, m.sessions, "!?").count() == 0


def test_nodes_with_direct_titles_rank_first(spark):
    rows = [("a", "Note", "talk of DEPLOY-KEY rotation for service"), ("b", "Note", "deploy-key deploy-key deploy-key said often and service"), ("c", "Note", "plain words")]
    nodes = summaries.leaves(frame(spark, rows))
    got = rank.rank_nodes(nodes, "deploy-key service").collect()
    assert [r["hits"] for r in got] == [2, 2, 0] and got[0]["directness"] > got[1]["directness"]
    assert rank.search_nodes(nodes, "plain", 5).count() == 1 and rank.search_nodes(nodes, "", 2).count() == 2


@pytest.fixture(scope="module")
def m(spark):
    """A long session with one sentence to find, and a short one elsewhere."""
    n = 64
    rows = [("main", "UserPromptSubmit" if i % 2 == 0 else "Stop", "the needle is hidden in drawer seven" if i == 3 else f"step {i} of ordinary work on the parser") for i in range(n)]
    return memory(frame(spark, [*rows, ("side", "Note", "a side note on gardening", "/g")]))


@pytest.mark.parametrize("budget", [16, 120, 800])
def test_packs_keep_to_their_budget(m, budget):
    out = context.pack(m, "needle drawer", budget)
    assert out.chars <= max(16, budget) * 4 + 18 and out.tokens <= budget + 5
    if budget >= 120:
        assert "drawer seven" in out.markdown and out.items[0][1] == "event"
    if budget == 800:
        kinds = [i[1] for i in out.items]
        assert "summary" in kinds and kinds == sorted(kinds, key=["event", "note", "summary", "checkpoint"].index)


def test_packs_without_words_and_of_given_sessions(m):
    plain = context.pack(m, "", 1200)
    assert {i[2] for i in plain.items} == {"side"} and any(i[1] == "note" for i in plain.items)
    given = context.pack(m, "", 1200, session_ids=["main"])
    assert {i[2] for i in given.items} == {"main"} and any(i[1] == "checkpoint" for i in given.items)
    assert {i[2] for i in context.pack(m, "gardening", 1200, cwd="/w").items} == {"side"}
    assert {i[2] for i in context.pack(m, "ordinary", 1200, current="main").items} == {"main"}


def test_expanding_a_query_reaches_the_evidence(m):
    assert m.nodes.agg(F.max("depth")).first()[0] == 2
    out = context.expand_query(m, "needle drawer", 2000)
    assert "drawer seven" in out.markdown and not out.truncated and {i[1] for i in out.items} == {"event", "summary"}
    assert out.chars <= 8000
    small = context.expand_query(m, "needle drawer", 32)
    assert small.truncated and small.chars <= 128
    assert context.expand_query(m, "step parser", 4000, overview=True).items[1][-1].split("\n")[0].endswith("d2")
    assert "drawer seven" in context.expand_query(m, "needle", 2000, session_ids=["main"]).markdown
    assert context.expand_query(m, "zebra", 2000).markdown.endswith("No matching evidence found.\n")
    with pytest.raises(ValueError):
        context.expand_query(m, "  ")


def test_describe_and_expand_nodes(m):
    top = summaries.top_nodes(m.nodes.where("session_id = 'main'")).first()
    assert top["source_event_count"] == 64 and summaries.lineage(m.nodes, m.nodes.where(F.col("node_id") == top["node_id"])).count() == 64
    got = context.expand(m, top["node_id"], "needle").collect()
    assert [r["kind"] for r in got].count("node") == 2 and any(r["hits"] == 1 and "needle" in r["text"] for r in got)
    assert context.describe(m, node_id=top["node_id"]).first()["sources"] == 2
    assert context.describe(m, session_id="side").first()["source_event_count"] == 1
    for wrong in ({"node_id": "x"}, {"session_id": "x"}):
        with pytest.raises(LookupError):
            context.describe(m, **wrong)
    with pytest.raises(ValueError):
        context.describe(m)


def test_graphs_take_summaries_with_their_lineage(m):
    assert [graph.summary_budget(n) for n in (4, 20, 40, 200)] == [1, 8, 10, 50]
    nodes, edges = graph.with_summaries(m.events, m.nodes, "main", 40)
    kinds = {r["kind"]: r["count"] for r in nodes.groupBy("kind").count().collect()}
    assert sum(kinds.values()) <= 40 and kinds["summary"] == 10
    ids = {r[0] for r in nodes.select("node_id").collect()}
    assert all(r["from_id"] in ids and r["to_id"] in ids for r in edges.collect()) and edges.where("kind = 'summary_source'").count() > 0
    first = [r["depth"] for r in graph.lineage_first(m.nodes, "main", 4).collect()]
    assert first == [0, 0, 1, 2]


def test_graphs_find_the_deepest_of_many_nodes(spark):
    """More nodes than were once read, leaves first, against a walk over all of them."""
    level, rows = [f"n0-{i}" for i in range(2500)], []
    rows += [(n, "s", 0, "events", [f"e{i}"], f"{i:05}", f"{i:05}") for i, n in enumerate(level)]
    while len(level) > 1:
        depth, by_id = rows[-1][2] + 1, {r[0]: r for r in rows}
        parts = [level[i : i + 4] for i in range(0, len(level), 4)]
        rows += [(f"n{depth}-{i}", "s", depth, "nodes", p, by_id[p[0]][5], by_id[p[-1]][6]) for i, p in enumerate(parts)]
        level = [r[0] for r in rows[-len(parts) :]]
    rows.append(("lone", "t", 9, "events", ["e0"], "0", "9"))
    nodes = spark.createDataFrame(rows, "node_id string, session_id string, depth int, source_type string, source_ids array<string>, earliest_at string, latest_at string")
    by_id, walk = {r[0]: r for r in rows}, []

    def visit(n):
        if n not in walk:
            walk.append(n)
            for below in by_id[n][4] if by_id[n][3] == "nodes" else []:
                visit(below)

    visit(level[0])
    for limit in (0, 1, 5, 60, 301):
        assert {r["node_id"] for r in graph.lineage_first(nodes, "s", limit).collect()} == set(walk[:limit])
    apart = graph.lineage_first(nodes.where("depth < 4"), "s", 30).collect()  # many roots of one depth: the latest first
    roots = sorted((r for r in rows if r[2] == 3), key=lambda r: r[6], reverse=True)
    walk.clear()
    for r in roots[:3]:
        visit(r[0])
    assert {r["node_id"] for r in apart} == set(walk[:30])


def test_places_in_a_hot_key(spark):
    rng = random.Random(0)
    rows = [("hot", rng.random(), i) for i in range(500)] + [("cold", rng.random(), 1000 + i) for i in range(3)]
    got = ordering.numbered(spark.createDataFrame(rows, "k string, at double, id long").repartition(7), "k", "at").collect()
    for key in ("hot", "cold"):
        own = sorted((r["at"], r["place"]) for r in got if r["k"] == key)
        assert [p for _, p in own] == list(range(len(own)))


def test_snippets_and_excerpts(spark):
    text = "Topics: zebra, lion\nfirst line\n" + "x " * 150 + "the zebra crossed " + "y " * 150 + "\nlast"
    r = spark.createDataFrame([(text,)], "t string").select(tx.snippet(F.col("t"), "the zebra", 60).alias("s"), tx.excerpt(F.col("t"), "zebra", 40).alias("e"), tx.snippet(F.col("t"), "nothing", 60).alias("n")).first()
    assert "the zebra" in r["s"] and r["s"].startswith("...") and len(r["s"]) <= 60 and r["n"] == "Topics: zebra, lion"
    assert "zebra" in r["e"] and len(r["e"]) == 40 and r["e"].startswith("...")
    short = spark.createDataFrame([("abc",)], "t string").select(tx.excerpt(F.col("t"), "x", 2), tx.excerpt(F.col("t"), "x", 9)).first()
    assert tuple(short) == ("...", "abc")


def test_arguments():
    assert [args.limit(v, 10) for v in (None, 0, 7, 999)] == [10, 1, 7, 200]
    assert [args.positive(v, 5) for v in (None, -1, 2.9, float("inf"))] == [5, 5, 2, 5]
    assert [args.cursor(v) for v in (None, "", "12", "x", "-3")] == [0, 0, 12, 0, 0]
    assert args.timestamp("2026-01-02T03:04:05.678+01:00", "since") == "2026-01-02T02:04:05.678Z" and args.timestamp("", "since") is None
    assert args.days_before("2026-01-10T00:00:00.000Z", 9) == "2026-01-01T00:00:00.000Z"
    with pytest.raises(ValueError, match="since must be a valid ISO-8601 timestamp"):
        args.timestamp("soon", "since")


def test_cross_shapes_as_plain_counting(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.randint(0, 3)}", i, rng.choice(["event", "item"])) for i in range(300)]
    held, want = {}, []
    for k, i, shape in rows:
        other = "item" if shape == "event" else "event"
        if held.get((k, other), 0):
            held[k, other] -= 1
        else:
            held[k, shape] = held.get((k, shape), 0) + 1
            want.append(i)
    got = upkeep.cross_shape(spark.createDataFrame(rows, "k string, at long, shape string"), ["k"], "at")
    assert sorted(r["at"] for r in got.collect()) == want


def test_the_recovery_stream_is_its_batch_twin(spark, tmp_path):
    hooks = ["UserPromptSubmit", "PostCompact", "Stop", "PostToolUse", "PreToolUse", "SessionStart"]
    rng = random.Random(8)
    rows = [(f"e{i}", f"s{i % 3}", i, rng.choice(hooks), "pack" if rng.random() < 0.2 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id string, session_id string, seq long, hook_event string, tool_name string")
    df = df.withColumn("tool_name", F.when(F.col("hook_event") == "PreToolUse", F.col("tool_name")))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ingest.recovery_actions(ingest.open_stream(spark, df.schema, f"{tmp_path}/in"))
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    key = lambda d: sorted(map(tuple, d.select("session_id", "event_id", "action").collect()))
    got = key(spark.read.parquet(f"{tmp_path}/out"))
    assert got and got == key(ingest.recovery_actions_batch(df))


def test_windowed_counts_and_running_sessions(spark, tmp_path):
    e = frame(spark, [("a", "Stop", "x"), ("a", "Note", "y"), ("b", "Stop", "z")])
    e.write.parquet(f"{tmp_path}/in")
    for name, of in (("n", ingest.windowed_counts), ("s", ingest.session_state)):
        q = of(ingest.open_stream(spark, e.schema, f"{tmp_path}/in")).writeStream.format("memory").queryName(f"q_{name}").outputMode("complete").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
    assert {r["hook_event"]: r["count"] for r in spark.table("q_n").collect()} == {"Stop": 2, "Note": 1}
    assert {r["session_id"]: r["event_count"] for r in spark.table("q_s").collect()} == {"a": 2, "b": 1}


def test_touched_sessions_are_given_to_the_caller(spark, tmp_path):
    e = frame(spark, [("a", "Stop", "x"), ("b", "Note", "y"), ("a", "Stop", "z")])
    seen = []
    for part in (e.limit(2), e):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.ingest(ingest.open_stream(spark, e.schema, f"{tmp_path}/in"), f"file://{tmp_path}/t", f"{tmp_path}/c", lambda s: seen.append(sorted(r[0] for r in s.collect())))
    assert seen == [["a", "b"], ["a"]] and ingest.read_table(spark, e.schema, f"file://{tmp_path}/t").count() == 3


def test_usage_follows_links_down_and_ends_in_cycles(spark):
    links = [("r", None), ("a", "r"), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")]
    s = spark.createDataFrame([(i, p, 10) for i, p in links], "session_id string, parent_session_id string, total_tokens long")
    assert sorted(r[0] for r in sessions.descendants(s, s.where("session_id = 'r'")).collect()) == ["a", "b", "c", "r"]
    assert sorted(r[0] for r in sessions.descendants(s, s.where("session_id = 'x'")).collect()) == ["x", "y"]
    assert sessions.usage_with_descendants(s).first()["total_tokens"] == 40
