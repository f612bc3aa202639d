"""A log held against its last reading, by files changed in every way, against plain Python's reading of them."""

import json
import os

import pytest
from pyspark.sql import functions as F

from threadlake.operators import normalize, store
from threadlake.sources import log, reconcile

from .test_store import rows_of


def event(i, session=None, text="plan the rollout"):
    return {"schema_version": 1, "event_id": f"e{i}", "timestamp": f"2026-01-01T00:{i // 60:02d}:{i % 60:02d}.000Z", "hook_event": "UserPromptSubmit", "session_id": session or f"s{i % 3}", "cwd": "/c", "repo_root": None, "payload": {"prompt": f"{text} {i}"}}


class Disk:
    """A log's files, and what plain Python reads in them."""

    def __init__(self, path):
        self.path, self.clock = path, 1_700_000_000
        path.mkdir()

    def write(self, name, rows, mode="w"):
        with open(self.path / name, mode) as f:
            f.write("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
        self.clock += 10
        os.utime(self.path / name, (self.clock, self.clock))

    def events(self):
        out = {}
        for p in sorted(self.path.iterdir()):
            for x in p.read_text().split("\n"):
                if x.startswith("{"):
                    out.setdefault(json.loads(x)["event_id"], json.loads(x))
        return out


def bind(rows):
    rows = rows.select("event_id", "session_id", F.col("timestamp").alias("ts"), F.col("byte_offset").alias("seq"), "hook_event", "cwd", "repo_root", "payload", "tool_name", F.lit(None).cast("string").alias("git_branch"))
    return normalize.read_payload(rows)


def statuses(d):
    return {r["segment"].rsplit("/", 1)[1]: r["status"] for r in d.statuses.collect()}


def ids(df):
    return sorted(r["event_id"] for r in df.select("event_id").collect())


def test_a_store_follows_what_happens_to_its_log(spark, tmp_path):
    disk = Disk(tmp_path / "a log")
    disk.write("a.jsonl", [event(i) for i in range(12)])
    disk.write("b.jsonl", [event(i) for i in range(12, 20)] + [event(3)])
    disk.write("c.jsonl", [event(i) for i in range(20, 26)])
    state, held = reconcile.LogState(spark, f"file://{tmp_path}/state"), store.Store(spark, f"file://{tmp_path}/s", 4)

    def step():
        now = reconcile.LogState(spark, state.path)
        d = now.difference(str(disk.path))
        reconcile.apply(held, now, d, bind)
        return d

    def same_as_new():
        want, m = disk.events(), held.memory()
        assert ids(m.events) == sorted(want)
        fresh = store.Store(spark, f"file://{tmp_path}/fresh", 4)
        fresh.ingest(bind(reconcile.LogState(spark, f"file://{tmp_path}/new").difference(str(disk.path)).events))
        assert rows_of(m.nodes, "node_id") == rows_of(fresh.memory().nodes, "node_id")
        assert rows_of(m.sessions, "session_id") == rows_of(fresh.memory().sessions, "session_id")
        assert rows_of(m.summaries, "session_id") == rows_of(fresh.memory().summaries, "session_id")
        docs = lambda s: sorted(map(tuple, s.index.documents().select("kind", "key").collect()))
        assert docs(held) == docs(fresh)

    first = step()
    assert (first.how, first.malformed, statuses(first)) == ("tail", 0, {"a.jsonl": "new", "b.jsonl": "new", "c.jsonl": "new"})
    again = step()
    assert again.how == "same" and again.events.count() == 0 and set(statuses(again).values()) == {"same"}
    # Lines that are appended are all that comes; a file that was only touched has none.
    disk.write("c.jsonl", ["", *[event(i) for i in range(26, 30)]], "a")
    disk.write("a.jsonl", [], "a")
    tail = step()
    assert (tail.how, ids(tail.events), tail.gone.count()) == ("tail", ["e26", "e27", "e28", "e29"], 0)
    assert statuses(tail) == {"a.jsonl": "same", "b.jsonl": "same", "c.jsonl": "appended"}
    # One event rewritten in place with its size kept, one taken out, a session that goes whole, an event left in its second place.
    disk.write("a.jsonl", [event(0, text="PLAN the rollout"), *[event(i) for i in range(1, 12) if i not in (3, 5)]])
    disk.write("c.jsonl", [event(i) for i in range(20, 30) if i % 3 != 1])
    d = step()
    assert d.how == "difference" and statuses(d) == {"a.jsonl": "changed", "b.jsonl": "same", "c.jsonl": "changed"} and not d.blocked
    assert ids(d.events) == ["e0"] and ids(d.gone) == sorted(["e0", "e5", "e22", "e25", "e28"])
    assert ids(held.memory().events) == sorted(disk.events())
    asked = spark.createDataFrame([("e0",), ("e3",), ("e5",), ("e29",), ("none",), ("e0",)], "event_id string")
    got = reconcile.LogState(spark, state.path).look_up(asked)
    assert {r["event_id"]: json.loads(r["payload"]) for r in got.collect()} == {k: disk.events()[k]["payload"] for k in ("e0", "e3", "e29")}
    # While a line is broken nothing is forgotten, but what is new comes in; once it is mended the difference is made up for.
    os.remove(disk.path / "b.jsonl")
    disk.write("c.jsonl", ["{broken", event(40)], "a")
    d = step()
    assert d.blocked and d.malformed == 1 and ids(d.events) == ["e40"] and d.gone.count() == 0
    d = step()
    assert d.blocked and d.events.count() == 0
    disk.write("c.jsonl", [event(i) for i in (*[i for i in range(20, 30) if i % 3 != 1], 40)])
    d = step()
    assert d.how == "difference" and ids(d.gone) == sorted(["e3", *[f"e{i}" for i in range(12, 20)]]) and d.events.count() == 0
    same_as_new()


def test_a_log_of_nothing(spark, tmp_path):
    disk = Disk(tmp_path / "log")
    disk.write("a.jsonl", [])
    state = reconcile.LogState(spark, f"file://{tmp_path}/state")
    d = state.difference(str(disk.path))
    state.commit(d)
    assert d.events.count() == 0 and d.malformed == 0 and state.look_up(spark.createDataFrame([("x",)], "event_id string")).count() == 0
    disk.write("a.jsonl", [event(1)], "a")
    for _ in range(2):  # a reading that was not committed is made again
        d = reconcile.LogState(spark, state.path).difference(str(disk.path))
        assert statuses(d) == {"a.jsonl": "new"} and ids(d.events) == ["e1"]
    state.commit(d)
    assert ids(state.look_up(d.events)) == ["e1"] and state.difference(str(disk.path)).how == "same"
    with pytest.raises(ValueError):
        state.commit(d)


@pytest.mark.parametrize("compress", [False, True])
def test_segments_are_published_under_their_names(spark, tmp_path, compress):
    rows = spark.createDataFrame([(f"seg{i % 2}", i, f"line é {i}") for i in range(50)], "segment string, place long, line string")
    for _ in range(2):
        log.publish(rows, f"file://{tmp_path}/out", compress)
    lines = log.read_lines(spark, str(tmp_path / "out"))
    got = sorted((r["segment"].rsplit("/", 1)[1].split(".")[0], r["line_no"], r["byte_offset"], r["line"]) for r in lines.collect())
    want, at = [], {0: 0, 1: 0}
    for i in range(50):
        want.append((f"seg{i % 2}", i // 2, at[i % 2], f"line é {i}"))
        at[i % 2] += len(f"line é {i}".encode()) + 1
    assert got == sorted(want)
