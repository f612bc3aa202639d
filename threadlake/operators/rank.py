"""Session search: two tiers over three indexes, evidence by kind, explainable discovery scores; ranking of nodes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.functions import text as tx
from threadlake.functions.text import query_terms, term_hits
from threadlake.operators import fts
from threadlake.operators import sessions as sessions_of
from threadlake.operators.postings import Index, parse
from threadlake.storage import sized, written

# What a match of each kind weighs, and the kinds' order where all else is equal.
KIND_WEIGHT = {"summary_node": 4, "session_summary": 3, "event": 1}
KIND_ORDER = {"summary_node": 3, "session_summary": 2, "event": 1}
#: Columns of an index that candidates keep; the text itself is joined again for the few that are shown.
KEPT = ["key", "session_id", "at", "depth", "sources", "source_tokens", "is_shown"]


def broad(query: str) -> bool:
    """Whether a query has four distinct words that are long or have a sign or digit."""
    words = {w.strip("-") for w in re.split(r"[^\w-]+", query.lower())}
    return sum(len(w) >= 3 or bool(re.search(r"[-_\d]", w)) for w in words) >= 4


def wants_suggestions(query: str) -> bool:
    """Whether a query asks for generated suggestions, which it does not find otherwise."""
    return bool(re.search(r"(?i)\b(hyperpersonalized|suggestions?)\b", query))


def event_index(events: DataFrame) -> DataFrame:
    """Events as an index of session, folder, repository, hook and text; what is counted is what the event says."""
    shown = F.lit(True)
    if "is_source" in events.columns:
        events, shown = events.where("is_indexed and not is_own_tool"), F.col("is_source") & ~F.col("is_suggestion")
    none = F.lit(0).cast("long")
    searched = F.col("search_text") if "search_text" in events.columns else F.col("text")
    fields = _fields("session_id", "cwd", "repo_root", "hook_event", searched)
    return events.select(F.col("event_id").alias("key"), "session_id", fields, F.col("text").alias("said"), F.col("ts").alias("at"), F.lit(0).alias("depth"), none.alias("sources"), none.alias("source_tokens"), shown.alias("is_shown"))


def node_index(nodes: DataFrame) -> DataFrame:
    """Nodes as an index of session, folder, repository, depth and content: text, topics and the ids of all events below."""
    fields = _fields("session_id", "cwd", "repo_root", F.col("depth").cast("string"), F.concat_ws("\n", "summary_text", "topics", "source_event_ids"))
    return nodes.select(F.col("node_id").alias("key"), "session_id", fields, F.col("summary_text").alias("said"), F.col("latest_at").alias("at"), "depth", F.col("source_event_count").alias("sources"), F.col("source_token_count").alias("source_tokens"), F.lit(True).alias("is_shown"))


def summary_index(summaries: DataFrame) -> DataFrame:
    """Session summaries as an index of folder, repository and content."""
    fields = _fields("cwd", "repo_root", "summary_text")
    return summaries.select(F.col("session_id").alias("key"), "session_id", fields, F.col("summary_text").alias("said"), F.col("updated_at").alias("at"), F.lit(0).alias("depth"), F.size("source_event_ids").cast("long").alias("sources"), F.lit(0).cast("long").alias("source_tokens"), F.lit(True).alias("is_shown"))


def _fields(*columns: str | Column) -> Column:
    return F.array(*[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns]).alias("fields")


def index_rows(events: DataFrame | None = None, nodes: DataFrame | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """What a stored index takes of events, nodes and summaries."""
    made = [("summary_node", nodes, node_index), ("session_summary", summaries, summary_index), ("event", events, event_index)]
    return reduce(DataFrame.unionByName, [f(rows).withColumn("kind", F.lit(kind)) for kind, rows, f in made if rows is not None])


class Matches:
    """The rows of an index that have any of a query's phrases, written once; both tiers are read from them.

    The index is read in one pass, which counts its documents and tokens too.
    """

    def __init__(self, docs: DataFrame, query: str, keep: list[str] = KEPT):
        strict, relaxed = fts.strict_phrases(query), fts.relaxed_phrases(query)
        phrases = [p for i, p in enumerate(strict + relaxed) if p not in (strict + relaxed)[:i]]
        self.which = {True: sorted({phrases.index(p) for p in strict}), False: sorted({phrases.index(p) for p in relaxed})}
        if self.which[True] == self.which[False] and len(strict) < 2:
            self.which[False] = []
        keep = [c for c in keep if c in docs.columns]
        hits = term_hits(F.col("said"), query_terms(query)) if "said" in docs.columns else F.lit(0).cast("long")
        if not phrases:
            none = docs.limit(0).select(*keep, hits.alias("hits"), F.lit(0).cast("long").alias("dl"), F.array().cast("array<long>").alias("f"))
            self.rows, self.size = none, (0, 0)
            return
        seen = Observation()
        rows = fts.matched(docs, phrases, seen).withColumn("hits", hits)
        self.rows = written(rows.select(*keep, "hits", "dl", "f"), "matches")
        self.size = (seen.get["n"], seen.get["total"] or 0)

    def tier(self, every: bool) -> DataFrame:
        """Rows of a tier with their score."""
        return fts.scored(self.rows, self.size, self.which[every], every)

    def best(self, every: bool, k: int, wanted: DataFrame | None = None) -> DataFrame:
        """A tier's k best rows, of those that wanted (session_id or key) has, by BM25, then depth and recency."""
        rows = self.tier(every) if wanted is None else self.tier(every).join(wanted, wanted.columns, "left_semi")
        return rows.withColumn("score", F.round("score", 9)).orderBy("score", F.desc("depth"), F.desc("at"), "key").limit(k)


def evidence(rows: DataFrame) -> DataFrame:
    """Per query and session, the rows of the kind with the largest score, then count, then weight."""
    keys = ["qid", "session_id"]
    per = rows.groupBy(*keys, "kind").agg(F.sum("row_score").alias("kind_score"), F.count(F.lit(1)).alias("kind_count"))
    best = Window.partitionBy(*keys).orderBy(F.desc("kind_score"), F.desc("kind_count"), F.desc(_of_kind(KIND_ORDER)))
    chosen = per.withColumn("__at", F.row_number().over(best)).where("__at = 1").select(*keys, "kind")
    return rows.join(chosen, [*keys, "kind"], "left_semi")


def _of_kind(values: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]), F.col("kind"))


def discovery(per: DataFrame) -> DataFrame:
    """Add discovery score, confidence and reasons to sessions with their best match; is_broad tells of the query."""
    # Conditions, points and reasons.
    parts = [
        (F.col("kind") == "summary_node", 10, "summary-node match"), (F.col("kind") == "session_summary", 6, "session-summary match"), (F.col("kind") == "event", 0, "raw-event match"),
        (F.col("sources") >= 4, 12, "source-rich summary"), (F.col("sources").between(2, 3), 6, "multiple source events"),
        (F.col("source_tokens") >= 600, 8, "substantive source text"), (F.col("source_tokens").between(160, 599), 4, "nontrivial source text"),
        (F.col("event_count") >= 8, 8, "longer session"), (F.col("event_count").between(3, 7), 4, "multi-event session"), (F.col("event_count") == 2, 2, "prompt-outcome session"),
        (F.col("match_count") >= 2, F.least("match_count", F.lit(4)) * 2, "multiple matches"),
        (F.col("is_broad") & (F.col("event_count") <= 1), -24, "tiny session penalty"),
    ]
    total = F.col("score")
    for when, points, _ in parts:
        total = total + F.when(when, points).otherwise(0)
    reasons = F.array_compact(F.array(*[F.when(when, F.lit(why)) for when, _, why in parts]))
    out = per.withColumn("discovery_score", total.cast("long")).withColumn("reasons", F.array_join(reasons, ", "))
    return out.withColumn("confidence", F.when(F.col("discovery_score") >= 34, "high").when(F.col("discovery_score") >= 18, "medium").otherwise("low"))


SEARCHED = ["session_id", "kind", "score", "match_count", "last_match_at", "best_key", "discovery_score", "confidence", "reasons", "snippet"]


def ranked(rows: DataFrame, sessions: DataFrame, k: int, limit: int) -> DataFrame:
    """The best sessions of each query, with their rank, from candidates (qid, is_broad, kind, place up to k, hits and attributes)."""
    rows = rows.withColumn("row_score", F.col("hits") * _of_kind(KIND_WEIGHT))
    rows = rows.withColumn("first", (F.lit(max(KIND_ORDER.values())) - _of_kind(KIND_ORDER)) * F.lit(k) + F.col("place"))
    best = F.struct("row_score", "at", -F.col("first"))
    per = evidence(rows).groupBy("qid", "session_id", "kind").agg(
        F.sum("row_score").alias("score"), F.count(F.lit(1)).alias("match_count"), F.max("at").alias("last_match_at"), F.max("row_score").alias("best_score"),
        F.max_by("key", best).alias("best_key"), *[F.max_by(c, best).alias(c) for c in ("said", "doc") if c in rows.columns], F.max_by("sources", best).alias("sources"), F.max_by("source_tokens", best).alias("source_tokens"),
        F.min("first").alias("first"), F.first("is_broad").alias("is_broad"),
    )
    out = discovery(per.join(sessions.select("session_id", "event_count"), "session_id"))
    order = [F.desc("discovery_score"), F.desc("score"), F.desc("best_score"), F.desc("match_count"), F.desc("last_match_at"), F.asc("first")]
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return out.where(F.col("rank") <= limit)


def _facts(queries: DataFrame) -> DataFrame:
    """(qid, is_broad, wants_suggestions, terms) of queries (qid, query)."""

    def run(batches):
        for pdf in batches:
            q = pdf["query"].fillna("")
            yield pdf[["qid"]].assign(is_broad=q.map(broad), wants_suggestions=q.map(wants_suggestions), terms=q.map(query_terms))

    return queries.select("qid", "query").mapInPandas(run, "qid long, is_broad boolean, wants_suggestions boolean, terms array<string>")


def search_many(index: Index, sessions: DataFrame, queries: DataFrame, limit: int = 10, cwd: str | None = None, repo_root: str | None = None, exclude: tuple[str, ...] = (), texts: bool = True) -> DataFrame:
    """The best sessions for each of queries (qid, query), by a stored index: one plan for all queries.

    Strict matches count where a query has any, looser ones where not; a query without words finds nothing.
    Filters by folder and repository choose among documents before the best are taken, exclusions after.
    Returns qid, rank and SEARCHED but for the snippet, with said, the best match's text, if texts are asked for.
    """
    wanted = None
    for name, value in (("cwd", cwd), ("repo_root", repo_root)):
        if value is not None:
            wanted = (sessions if wanted is None else wanted).where(F.col(name) == value)
    wanted = wanted if wanted is None else wanted.select("session_id")
    k = max(limit * 20, 50)
    asked = written(parse(queries), "asked")
    facts = written(_facts(queries), "facts")

    def tier(asked: DataFrame) -> DataFrame:
        rows = index.best(asked, k, wanted)
        rows = rows.where(~F.col("session_id").isin(list(exclude))) if exclude else rows
        rows = rows.join(sized(facts, 400), "qid").where("is_shown or wants_suggestions")
        low = F.lower("said")
        hits = F.coalesce(F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + tx.has_term(low, t).cast("long")), F.lit(0))
        # Texts are met once, after the best are known, and not carried on: a query has hundreds of candidates.
        return written(index.texts(written(rows, "best")).withColumn("hits", hits).drop("terms", "said"), "candidates")

    rows = tier(asked.where("every"))
    left = written(asked.where("not every").join(sized(written(rows.select("qid").distinct(), "answered"), 16), "qid", "left_anti"), "left")
    if not left.isEmpty():
        rows = rows.unionByName(tier(left))
    out = ranked(rows, sessions, k, limit).select("qid", "rank", *[c for c in SEARCHED if c != "snippet"], "doc")
    return index.texts(written(out, "shown")).drop("doc") if texts else out.drop("doc")


def search(
    events: DataFrame, nodes: DataFrame, summaries: DataFrame, sessions: DataFrame, query: str, limit: int = 10,
    exclude: tuple[str, ...] = (), cwd: str | None = None, repo_root: str | None = None, index: Index | None = None,
) -> DataFrame:
    """The best sessions for a query; strict matches first, looser ones only if there are none; without words the latest.

    With a stored index the query reads its terms' postings alone. Without one each kind's rows are read once:
    those that have any of the query's words are written with their counts, and tiers, scores and evidence
    come from those. Scores are those of all documents, whatever filters choose among them.
    """
    if not query.strip():
        for name, value in (("cwd", cwd), ("repo_root", repo_root)):
            sessions = sessions if value is None else sessions.where(F.col(name) == value)
        sessions = sessions.where(~F.col("session_id").isin(list(exclude))) if exclude else sessions
        none = {"kind": "string", "score": "long", "match_count": "long", "last_match_at": "string", "best_key": "string", "discovery_score": "long", "confidence": "string", "reasons": "string", "snippet": "string"}
        latest = sessions.orderBy(F.desc("last_seen"), "session_id").limit(limit)
        return latest.select("session_id", *[F.lit(None).cast(t).alias(n) for n, t in none.items()])
    if index is not None:
        queries = sessions.sparkSession.createDataFrame([(0, query)], "qid long, query string")
        out = search_many(index, sessions, queries, limit, cwd, repo_root, exclude)
    else:
        out = _scan(events, nodes, summaries, sessions, query, limit, exclude, cwd, repo_root)
    return written(out, "found").withColumn("snippet", tx.snippet(F.col("said"), query)).orderBy("rank").select(*SEARCHED)


def search_log(events: DataFrame, query: str, limit: int = 10, exclude: tuple[str, ...] = (), cwd: str | None = None, repo_root: str | None = None) -> DataFrame:
    """Sessions for a query from the log alone, without an index: rolled up from the events that have the query or one of its words anywhere, the latest first."""
    for name, value in (("cwd", cwd), ("repo_root", repo_root)):
        events = events if value is None else events.where(F.col(name) == value)
    rows = events.where(~F.col("session_id").isin(list(exclude))) if exclude else events
    if "is_source" in rows.columns:
        rows = rows.where(F.col("is_suggestion") if wants_suggestions(query) else F.lit(False)).unionByName(rows.where("is_source and not is_suggestion"))
    found = rows.where(tx.has_query(F.to_json(F.struct(*events.columns)), query))
    return sessions_of.listing(sessions_of.rollup(found), limit)


def _scan(events: DataFrame, nodes: DataFrame, summaries: DataFrame, sessions: DataFrame, query: str, limit: int, exclude: tuple[str, ...], cwd: str | None, repo_root: str | None) -> DataFrame:
    """search() without a stored index."""
    scoped = sessions
    for name, value in (("cwd", cwd), ("repo_root", repo_root)):
        scoped = scoped if value is None else scoped.where(F.col(name) == value)
    k = max(limit * 20, 50)
    indexes = {"summary_node": node_index(nodes), "session_summary": summary_index(summaries), "event": event_index(events)}
    found = {kind: Matches(docs, query) for kind, docs in indexes.items()}
    wanted = scoped.select("session_id") if cwd is not None or repo_root is not None else None
    for every in (True, False):
        parts = []
        for kind, m in found.items():
            place = F.row_number().over(Window.partitionBy("kind").orderBy("score", F.desc("depth"), F.desc("at"), "key"))  # k rows at most
            parts.append(m.best(every, k, wanted).withColumn("kind", F.lit(kind)).withColumn("place", place))
        rows = reduce(DataFrame.unionByName, parts)
        rows = rows.where(~F.col("session_id").isin(list(exclude))) if exclude else rows
        rows = written(rows if wants_suggestions(query) else rows.where("is_shown"), "candidates")
        if not rows.isEmpty():
            break
    texts = reduce(DataFrame.unionByName, [docs.select(F.lit(kind).alias("kind"), "key", "said") for kind, docs in indexes.items()])
    rows = texts.join(sized(rows.withColumn("qid", F.lit(0).cast("long")).withColumn("is_broad", F.lit(broad(query))), 400), ["kind", "key"])
    return ranked(rows, sessions, k, limit)


def rank_columns(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes with what ranks them for a context."""
    terms = query_terms(query)
    heading, subjects = tx.node_title(F.col("summary_text")), F.array_join("topics", " ")
    ids = F.greatest(F.size("source_ids").cast("long"), "source_event_count")
    support = F.least(F.lit(8.0), F.log2(ids + 1.0)) * 2 + F.least(F.lit(8.0), F.log2(F.greatest(F.lit(1), "source_token_count") / 120 + 1))
    return nodes.withColumns(
        {
            "focused_hits": term_hits(F.concat_ws("\n", heading, "topics"), terms),
            "directness": (tx.directness(heading, terms, 5.0) + tx.directness(subjects, terms, 2.5)).cast("double"),
            "hits": term_hits(F.concat_ws("\n", "summary_text", "topics", "source_event_ids"), terms),
            "support": F.round(support, 4),
        }
    )


def rank_order(query: str) -> list[Column]:
    """Title and topic hits, directness, all hits, shallow first, support, recency; without words shallow and late first."""
    if not query_terms(query):
        return [F.asc("depth"), F.desc("latest_at"), F.asc("node_id")]
    return [F.desc("focused_hits"), F.desc("directness"), F.desc("hits"), F.asc("depth"), F.desc("support"), F.desc("latest_at"), F.asc("node_id")]


def rank_nodes(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes in the order in which a context takes them."""
    return rank_columns(nodes, query).orderBy(*rank_order(query)).select("node_id", "depth", "focused_hits", "directness", "hits", "support")


def _best_keys(kind: str, docs: DataFrame, query: str, k: int, wanted: DataFrame | None, index: Index | None) -> DataFrame:
    """(key) of the k best documents of a kind for a query, strict matches first, looser ones only if there are none."""
    if index is None:
        m = Matches(docs, query)
        for every in (True, False):
            best = written(m.best(every, k, wanted).select("key"), "best")
            if not best.isEmpty():
                break
        return best
    spark = index.spark
    asked = written(parse(spark.createDataFrame([(0, query)], "qid long, query string")), "asked")
    for every in ("every", "not every"):
        best = written(index.best(asked.where(every), k, wanted, kind).select("key"), "best")
        if not best.isEmpty():
            break
    return best


def search_nodes(nodes: DataFrame, query: str, limit: int = 10, sessions: list[str] | None = None, cwd: str | None = None, index: Index | None = None, repo_root: str | None = None) -> DataFrame:
    """Nodes for a query by the two tiers, then by rank; without words the deepest and latest."""
    rows = nodes
    for name, value in (("cwd", cwd), ("repo_root", repo_root)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    own = (lambda d: d.where(F.col("session_id").isin(sessions))) if sessions else (lambda d: d)
    if not query.strip():
        return own(rows.orderBy(F.desc("depth"), F.desc("latest_at"), "node_id").limit(max(limit * 4, 20))).limit(limit)
    wanted = None if cwd is None and repo_root is None else rows.select(F.col("node_id").alias("key"))
    best = _best_keys("summary_node", node_index(nodes), query, max(limit * 10, 50), wanted, index)
    rows = own(rows.join(F.broadcast(best.select(F.col("key").alias("node_id"))), "node_id", "left_semi"))  # 50 rows, or 10 for each wanted
    return rank_columns(rows, query).orderBy(*rank_order(query)).limit(limit).select(*nodes.columns)


def search_events(events: DataFrame, query: str, limit: int = 3, sessions: list[str] | None = None, cwd: str | None = None, index: Index | None = None) -> DataFrame:
    """Source events for a query by the two tiers, then by the whole phrase, hits and recency."""
    rows = events if cwd is None else events.where(F.col("cwd") == cwd)
    rows = rows.where(F.col("session_id").isin(sessions)) if sessions else rows
    wanted = rows.select(F.col("event_id").alias("key")) if cwd is not None or sessions else None
    best = _best_keys("event", event_index(events), query, max(limit * 10, 50), wanted, index)
    rows = rows.join(F.broadcast(best.select(F.col("key").alias("event_id"))), "event_id", "left_semi")
    phrase = re.sub(r"\s+", " ", query).strip().lower()
    order = [F.desc(F.lower("text").contains(phrase)), F.desc(term_hits(F.col("text"), query_terms(query))), F.desc("ts"), F.desc("event_id")]
    return rows.orderBy(*order).limit(limit)


def quality(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Recall at 1 and 5 and the mean reciprocal rank of queries (rank null if not found): over all, and by each column."""
    ratio = lambda c: F.round(F.avg(c), 4)
    sets = ranks.groupingSets([[], *[[F.col(b)] for b in by]], *by)
    return sets.agg(
        F.count(F.lit(1)).alias("queries"), ratio(F.coalesce((F.col("rank") == 1).cast("double"), F.lit(0.0))).alias("recall_at_1"),
        ratio(F.coalesce((F.col("rank") <= 5).cast("double"), F.lit(0.0))).alias("recall_at_5"), ratio(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mean_reciprocal_rank"),
    )
