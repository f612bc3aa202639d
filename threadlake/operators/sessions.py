"""Session roll-ups, listings, usage and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.operators import normalize, summaries
from threadlake.storage import written


COUNTERS = list(normalize.COUNTERS)
#: Fields of a session whose latest value that is not null counts, and that not all events tables have.
LATEST = ["git_branch", "agent_role", "agent_nickname", "model", "reasoning_effort"]


def rollup(events: DataFrame) -> DataFrame:
    """One row for each session; where a field changes, its latest arrival counts, and of counters the largest value.

    Events need not have all of LATEST and COUNTERS; sessions have what there is. An event's tokens count as
    total_tokens where it has no counters.
    """
    if "total_tokens" not in events.columns:
        events = events.withColumn("total_tokens", F.col("tokens"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    some = [last(c) for c in LATEST if c in events.columns] + [F.max(c).alias(c) for c in COUNTERS if c in events.columns]
    return events.groupBy("session_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("cwd", "seq").alias("cwd"), last("repo_root"), last("parent_session_id"),
        *some, F.count(F.lit(1)).alias("event_count"),
    )


def listing(sessions: DataFrame, limit: int = 50, offset: int = 0, cwd: str | None = None, since: str | None = None, until: str | None = None, roots_only: bool = False, parent: str | None = None) -> DataFrame:
    """A page of sessions, latest first; a time range keeps sessions that overlap it."""
    if cwd is not None:
        sessions = sessions.where(F.col("cwd") == cwd)
    if since is not None:
        sessions = sessions.where(F.col("last_seen") >= since)
    if until is not None:
        sessions = sessions.where(F.col("first_seen") <= until)
    if roots_only:
        sessions = sessions.where(F.col("parent_session_id").isNull())
    if parent is not None:
        sessions = sessions.where(F.col("parent_session_id") == parent)
    return sessions.orderBy(F.desc("last_seen"), "session_id").offset(offset).limit(limit)


def usage(sessions: DataFrame) -> DataFrame:
    """How many sessions, and the sums of their token counters; a counter that there is not is 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)) if c in sessions.columns else F.lit(0).cast("long")
    return sessions.agg(F.count(F.lit(1)).alias("sessions"), *[total(c).alias(c) for c in COUNTERS])


def descendants(sessions: DataFrame, roots: DataFrame) -> DataFrame:
    """Session ids of roots and all below them, by joins level by level; ids seen before are not followed again.

    Each level is written, so that none is computed twice; a cycle ends where nothing new is found.
    """
    links = written(sessions.select("session_id", "parent_session_id").where("parent_session_id is not null"), "links")
    levels = [written(roots.select("session_id").distinct(), "roots")]
    while not levels[-1].isEmpty():
        found = reduce(DataFrame.unionByName, levels)
        below = links.join(levels[-1].withColumnRenamed("session_id", "parent_session_id"), "parent_session_id").select("session_id").distinct()
        levels.append(written(below.join(found, "session_id", "left_anti"), "found"))
    return reduce(DataFrame.unionByName, levels)


def usage_with_descendants(sessions: DataFrame, **filters) -> DataFrame:
    """Usage of all sessions below the roots that match the filters; filters hold for roots alone."""
    roots = sessions.where("parent_session_id is null")
    for name, value in filters.items():
        roots = roots.where(F.col(name) == value)
    return usage(sessions.join(descendants(sessions, roots), "session_id", "left_semi"))


def current(sessions: DataFrame, **filters) -> DataFrame:
    """The session seen last."""
    for name, value in filters.items():
        sessions = sessions.where(F.col(name) == value)
    return sessions.orderBy(F.desc("last_seen"), "session_id").limit(1)


def page(events: DataFrame, session_id: str, limit: int, offset: int = 0) -> DataFrame:
    """Events of a session in order."""
    return events.where(F.col("session_id") == session_id).orderBy("ts", "seq").offset(offset).limit(limit)


def recent(events: DataFrame, session_id: str, limit: int = 20) -> DataFrame:
    """The last events of a session, in order."""
    return events.where(F.col("session_id") == session_id).orderBy(F.desc("ts"), F.desc("seq")).limit(limit).orderBy("ts", "seq")


def hook_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("hook_event").agg(F.count(F.lit(1)).alias("n"))


def index_stats(events: DataFrame) -> DataFrame:
    """Totals over all events."""
    return events.agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("session_id").alias("sessions"), F.max("ts").alias("latest_at"),
        F.countDistinct("tool_use_id").alias("tool_uses"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("text_bytes"),
    )


def head_tail_sample(events: DataFrame, head: int = 120, tail: int = 240, recent_: int = 40) -> DataFrame:
    """What a session summary reads: first and last signals, and the last events of any kind."""
    return summaries.session_sample(events, head, tail, recent_)


def rebuild_triggers(events: DataFrame) -> DataFrame:
    """Prompts that start a rebuild: those whose number in the session leaves 0 or 1 on division by 8."""
    w = Window.partitionBy("session_id").orderBy("ts", "seq")
    n = F.row_number().over(w)
    out = events.withColumn("event_no", n.cast("long")).where("hook_event = 'UserPromptSubmit'")
    return out.where(F.col("event_no") % 8 <= 1).select("session_id", "event_id", "event_no")


def next_cursor(offset: int, limit: int, page: DataFrame, total: int) -> str | None:
    """The cursor of the page after this one, if there is one."""
    shown = min(limit, max(0, total - offset))
    return str(offset + shown) if offset + shown < total else None


def freshness(events: DataFrame, nodes: DataFrame, summaries_: DataFrame) -> DataFrame:
    """How far the derived tables go: the latest event and node, the deepest node, and sessions with either kind of summary."""
    e = events.agg(F.max("ts").alias("latest_event_at"))
    n = nodes.agg(F.max("latest_at").alias("latest_node_at"), F.max("depth").alias("max_depth"), F.countDistinct("session_id").alias("sessions_with_nodes"))
    s = summaries_.agg(F.countDistinct("session_id").alias("sessions_with_summary"))
    return e.crossJoin(n).crossJoin(s)  # one row each


def has_event(events: DataFrame, event_id: str) -> bool:
    return not events.where(F.col("event_id") == event_id).isEmpty()


def recount(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Sessions with their events counted anew, 0 for those that have none left."""
    now = events.groupBy("session_id").agg(F.count(F.lit(1)).alias("__now"))
    return sessions.join(now, "session_id", "left").withColumn("event_count", F.coalesce("__now", F.lit(0))).drop("__now")


def upsert(table: DataFrame, fresh: DataFrame, key: str = "session_id") -> DataFrame:
    """A derived table with the rows of some keys replaced by new ones."""
    return table.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def rebuilt(table: DataFrame, events: DataFrame, touched: DataFrame, derive) -> DataFrame:
    """A table derived by session, with the touched sessions derived again from all their events."""
    return upsert(table, derive(events.join(touched.select("session_id").distinct(), "session_id", "left_semi")))
