"""The session graph: positions, checkpoints, edges and counts, whatever share of the events one session has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.functions.text import node_title
from threadlake.operators.ordering import ordered

#: A checkpoint stands at every so many events.
CHECKPOINT_EVERY = 50


PLACED = ["session_id", "event_id", "ts", "seq", "hook_event", "turn_id", "tool_use_id"]
# Hooks that a checkpoint counts, and the names of their counts.
COUNTED = {"pre": "PreToolUse", "post": "PostToolUse", "prompts": "UserPromptSubmit", "stops": "Stop", "compacts": "PreCompact"}


def positions(events: DataFrame) -> DataFrame:
    """PLACED fields of events with their position in the session from 1, the event before, and the hooks counted up to each; given such, the same again."""
    if "position" in events.columns:
        return events
    own = lambda h: (F.col("hook_event") == h).cast("long")
    rows = ordered(events.select(*PLACED), "session_id", ["ts", "seq"], "position", {n: own(h) for n, h in COUNTED.items()}, {"previous_id": "event_id"})
    return rows.withColumns({"position": F.col("position") + 1} | {n: F.col(n) + own(h) for n, h in COUNTED.items()})


def checkpoints(events: DataFrame) -> DataFrame:
    """Events at which a checkpoint stands."""
    is_one = (F.col("position") % CHECKPOINT_EVERY == 0) | (F.col("hook_event") == "PreCompact")
    return positions(events).where(is_one).select("session_id", "event_id", "hook_event", "position")


def latest_checkpoint(events: DataFrame) -> DataFrame:
    """Each session's last checkpoint with the counts of hooks up to it, which run along with positions."""
    is_one = (F.col("position") % CHECKPOINT_EVERY == 0) | (F.col("hook_event") == "PreCompact")
    counts = F.struct("event_id", *COUNTED)
    last = positions(events).where(is_one).groupBy("session_id").agg(F.max_by(counts, "position").alias("c"), F.max("position").alias("position"))
    return last.select("session_id", "c.event_id", "position", *[f"c.{n}" for n in COUNTED])


def next_edges(events: DataFrame) -> DataFrame:
    """Each event's predecessor in its session."""
    return positions(events).select("session_id", F.col("previous_id").alias("from_id"), F.col("event_id").alias("to_id"), F.lit("next").alias("kind")).where("from_id is not null")


def tool_results(events: DataFrame) -> DataFrame:
    """Each tool result with the latest earlier call of the same tool use: an as-of join as one window."""
    w = Window.partitionBy("session_id", "tool_use_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    call = F.last(F.when(F.col("hook_event") == "PreToolUse", F.col("event_id")), ignorenulls=True).over(w)
    out = events.where("tool_use_id is not null").select("session_id", call.alias("from_id"), F.col("event_id").alias("to_id"), F.lit("tool_result").alias("kind"), "hook_event")
    return out.where("hook_event = 'PostToolUse' and from_id is not null").drop("hook_event")


def contains_edges(events: DataFrame) -> DataFrame:
    """Session to turn and turn to event; an event without a turn hangs on its session."""
    turn = F.concat_ws(":", F.lit("turn"), "session_id", "turn_id")
    session = F.concat(F.lit("session:"), "session_id")
    turns = events.where("turn_id is not null").select("session_id", session.alias("from_id"), turn.alias("to_id")).distinct()
    leaves = events.select("session_id", F.when(F.col("turn_id").isNull(), session).otherwise(turn).alias("from_id"), F.col("event_id").alias("to_id"))
    return turns.unionByName(leaves).withColumn("kind", F.lit("contains"))


def checkpoint_edges(events: DataFrame) -> DataFrame:
    return checkpoints(events).select("session_id", F.col("event_id").alias("from_id"), F.concat(F.lit("checkpoint:"), "event_id").alias("to_id"), F.lit("checkpoint").alias("kind"))


def edges(events: DataFrame) -> DataFrame:
    """All edges of all sessions, each once."""
    events = positions(events)
    out = next_edges(events).unionByName(tool_results(events)).unionByName(contains_edges(events)).unionByName(checkpoint_edges(events))
    return out.dropDuplicates(["from_id", "to_id", "kind"])


def nodes(events: DataFrame) -> DataFrame:
    """All nodes in the order in which they arise: session, turn, event, checkpoint."""
    e = positions(events)
    session = e.where("position = 1").select("session_id", F.concat(F.lit("session:"), "session_id").alias("node_id"), F.lit("session").alias("kind"), "position", F.lit(0).alias("part"))
    turn = e.where("turn_id is not null").groupBy("session_id", "turn_id").agg(F.min("position").alias("position"))
    turn = turn.select("session_id", F.concat_ws(":", F.lit("turn"), "session_id", "turn_id").alias("node_id"), F.lit("turn").alias("kind"), "position", F.lit(1).alias("part"))
    event = e.select("session_id", F.col("event_id").alias("node_id"), F.lit("event").alias("kind"), "position", F.lit(2).alias("part"))
    check = checkpoints(e).select("session_id", F.concat(F.lit("checkpoint:"), "event_id").alias("node_id"), F.lit("checkpoint").alias("kind"), "position", F.lit(3).alias("part"))
    return session.unionByName(turn).unionByName(event).unionByName(check)


def bounded(events: DataFrame, session_id: str, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """The first `limit` nodes of a session's graph, and the edges between them."""
    own = positions(events.where(F.col("session_id") == session_id))
    kept = nodes(own).orderBy("position", "part", "node_id").limit(limit)
    ids = kept.select("node_id")
    inside = edges(own).join(ids.withColumnRenamed("node_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("node_id", "to_id"), "to_id", "left_semi")
    return kept, inside


def node_counts(events: DataFrame) -> DataFrame:
    return nodes(events).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def edge_counts(events: DataFrame) -> DataFrame:
    return edges(events).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def summary_budget(limit: int) -> int:
    """How many of a graph's nodes may be summaries."""
    return min(max(-(-limit // 4), 8), limit // 2) if limit >= 20 else limit // 4


def lineage_first(nodes: DataFrame, session_id: str, limit: int) -> DataFrame:
    """A session's nodes for a graph: the deepest and latest, each with all that it is made of, until `limit`.

    All of the session's nodes take part. The driver looks at the ids and sources of the first `limit` of them and, depth
    by depth, of the first `limit` below those: whatever follows these comes after `limit` chosen ones.
    """
    own = nodes.where(F.col("session_id") == session_id)
    seen = own.select("node_id", "source_type", "source_ids")
    roots = own.orderBy(F.desc("depth"), F.desc("latest_at"), "earliest_at", "node_id").limit(limit).select(*seen.columns).collect()
    by_id, chosen, level = {r["node_id"]: r for r in roots}, dict[str, None](), [r["node_id"] for r in roots]
    below = lambda n: by_id[n]["source_ids"] if by_id[n]["source_type"] == "nodes" else []
    while level:
        level = list(dict.fromkeys(i for n in level for i in below(n)))
        new = [i for i in level if i not in by_id]
        by_id |= {r["node_id"]: r for r in seen.where(F.col("node_id").isin(new)).collect()} if new else {}
        level = [i for i in level if i in by_id][:limit]
    for r in roots:
        stack = [r["node_id"]]
        while stack and len(chosen) < limit:
            node = stack.pop()
            if node not in chosen and node in by_id:
                chosen[node] = None
                stack += reversed(below(node))
    return own.where(F.col("node_id").isin(list(chosen))).orderBy("depth", "earliest_at", "node_id")


def as_graph_nodes(nodes: DataFrame) -> DataFrame:
    """Summary nodes as nodes of a graph, labelled by depth and title."""
    label = F.concat(F.lit("D"), "depth", F.lit(" "), node_title(F.col("summary_text")))
    return nodes.select("session_id", "node_id", F.lit("summary").alias("kind"), F.col("latest_at").alias("ts"), label.alias("label"), "depth", "source_type", "source_ids")


def with_summaries(events: DataFrame, nodes: DataFrame, session_id: str, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """bounded() with summary nodes in what it leaves free, a quarter or so at least, and edges from them to their sources."""
    own = max(1, limit - summary_budget(limit))
    first = events.where(F.col("session_id") == session_id).orderBy("ts", "seq").limit(own)
    base, links = bounded(first, session_id, own)
    some = as_graph_nodes(lineage_first(nodes, session_id, max(0, limit - base.count())))
    both = base.select("session_id", "node_id", "kind").unionByName(some.select("session_id", "node_id", "kind"))
    to = some.select("session_id", F.col("node_id").alias("from_id"), F.explode("source_ids").alias("to_id"), F.lit("summary_source").alias("kind"))
    to = to.join(both.select(F.col("node_id").alias("to_id")), "to_id", "left_semi")
    return both, links.unionByName(to.select(*links.columns)).dropDuplicates(["from_id", "to_id", "kind"])


def checkpoint_tail(events: DataFrame, last: int = 5) -> DataFrame:
    """Each session's latest checkpoint with the ids of the last events up to it, in order."""
    events = positions(events)
    point = latest_checkpoint(events).select("session_id", F.col("event_id").alias("checkpoint"), "position")
    before = positions(events).select("session_id", "event_id", F.col("position").alias("at")).join(point, "session_id").where(F.col("at").between(F.col("position") - last + 1, F.col("position")))
    return before.groupBy("session_id", "checkpoint").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "event_id"))), lambda x: x["event_id"]).alias("last_events"))
