"""DuckDB SQL for what summaries and search give, written from their definitions and not from the Spark code."""

from __future__ import annotations

import re

from threadlake.functions import text as tx

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + ")"


def compact(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def truncated(x: str, n: int) -> str:
    c = compact(x)
    return f"(CASE WHEN length({c}) <= {n} THEN {c} ELSE rtrim(substr({c}, 1, {n - 1})) || '...' END)"


def title(x: str) -> str:
    t = f"regexp_replace(regexp_replace({compact(x)}, '^please\\s+', '', 'i'), '^(can you|could you|do you|does this)\\s+', '', 'i')"
    return f"coalesce(nullif({truncated(t, 88)}, ''), 'Session')"


def tokens(x: str) -> str:
    return f"CAST(greatest(1, ceil(length({compact(x)}) / 4)) AS BIGINT)"


def head_tail(x: str, most: int, head: int) -> str:
    return f"(CASE WHEN len({x}) <= {most} THEN {x} ELSE list_concat({x}[1:{head}], {x}[-{most - head}:]) END)"


def terms(x: str) -> str:
    words = f"list_transform(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}_-]+'), lambda w: regexp_replace(w, '^-+|-+$', '', 'g'))"
    return f"list_filter({words}, lambda w: length(w) >= 2 AND w NOT IN {STOP_SQL} AND (regexp_matches(w, '[-0-9]') OR length(w) >= 3))"


def topics(name: str, source: str, texts: str, keys: str) -> str:
    """CTEs that end in `name` (keys, topics): the topics of the list `texts` of each row of `source`."""
    return f"""
    {name}_a AS (SELECT {keys}, list_filter({texts}, lambda t: trim(t) <> '') AS said FROM {source}),
    {name}_b AS (SELECT {keys}, len(said) AS n, unnest(said) AS text, unnest(range(len(said))) AS i FROM {name}_a),
    {name}_c AS (SELECT {keys}, n, i, {terms('text')}[1:80] AS w FROM {name}_b),
    {name}_d AS (SELECT {keys}, n, i, unnest(w) AS term, unnest(range(len(w))) AS k FROM {name}_c),
    {name}_e AS (SELECT {keys}, term, least(count(*), 2) * 6 + CASE WHEN contains(term, '-') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(term, '[0-9]') THEN 3 ELSE 0 END
        + CASE WHEN max(i) = max(n) - 1 THEN 8 ELSE 0 END AS score, max(i) AS late, min(i * 1000 + k) AS early FROM {name}_d GROUP BY {keys}, term),
    {name}_f AS (SELECT {keys}, term, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, late DESC, early) AS nr FROM {name}_e),
    {name} AS (SELECT {keys}, list(term ORDER BY nr) AS topics FROM {name}_f WHERE nr <= 16 GROUP BY {keys})"""


NODE = "node_id, session_id, depth, chunk, event_ids, summary_text, token_count, source_token_count, source_type, source_ids, n_events, earliest_at, latest_at, cwd, topics"


def _text(head: str, focus: str, bullets: str) -> str:
    return f"""concat_ws(chr(10), {head}, 'Focus: ' || {title(focus)}, CASE WHEN len(topics) > 0 THEN 'Topics: ' || array_to_string(topics, ', ') END,
        CASE WHEN len({bullets}) > 0 THEN array_to_string({head_tail(bullets, 6, 3)}, chr(10)) END)"""


def _id(depth: int, kind: str) -> str:
    return f"'summary:' || session_id || ':d{depth}:' || substr(sha256(concat_ws(chr(10), session_id, '{depth}', '{kind}', array_to_string(ids, chr(10)))), 1, 24)"


def dag(depths: int = 8) -> str:
    """CTEs after ev that end in nodes (NODE)."""
    out = f""", r AS (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) - 1) // 8 AS chunk FROM ev WHERE text IS NOT NULL),
    g0 AS (SELECT session_id, chunk, list(event_id ORDER BY ts, event_id) AS ids, list(text ORDER BY ts, event_id) AS texts, list(cwd ORDER BY ts, event_id)[-1] AS cwd,
        list(hook_event ORDER BY ts, event_id)[-1] AS hook, min(ts) AS earliest_at, max(ts) AS latest_at, sum({tokens('text')}) AS source_tokens, list_filter(list(text ORDER BY ts, event_id), lambda t: t <> '') AS said
        FROM r GROUP BY session_id, chunk),
    {topics('t0', 'g0', 'said', 'session_id, chunk')},
    h0 AS (SELECT g.*, coalesce(topics, []) AS topics FROM g0 g LEFT JOIN t0 USING (session_id, chunk)),
    i0 AS (SELECT *, {_text("'D0 leaf summary covering ' || len(ids) || ' high-signal events.'", 'coalesce(said[-1], hook)', f"list_transform(said, lambda t: '- ' || {truncated('t', 180)})")} AS summary_text FROM h0),
    n0 AS (SELECT {_id(0, 'events')} AS node_id, session_id, 0 AS depth, chunk, ids AS event_ids, summary_text, {tokens('summary_text')} AS token_count, CAST(source_tokens AS BIGINT) AS source_token_count,
        'events' AS source_type, ids AS source_ids, CAST(len(ids) AS BIGINT) AS n_events, earliest_at, latest_at, cwd, topics FROM i0)"""
    for d in range(1, depths + 1):
        p, by = f"n{d - 1}", "ORDER BY earliest_at, node_id"
        bullets = f"list_transform(below, lambda t: '- d{d - 1} ' || {truncated('t', 180)})"
        head = f"'D{d} condensed summary covering ' || len(ids) || ' D{d - 1} summary nodes.'"
        out += f""",
    g{d} AS (SELECT session_id, chunk // 4 AS chunk, list(node_id {by}) AS ids, list(summary_text {by}) AS below, list(array_to_string(topics, ' ') {by}) AS subjects, list(cwd {by})[-1] AS cwd,
        min(earliest_at) AS earliest_at, list(latest_at {by})[-1] AS latest_at, flatten(list(event_ids {by})) AS event_ids, sum(source_token_count) AS source_tokens, sum(n_events) AS n_events
        FROM {p} WHERE session_id IN (SELECT session_id FROM {p} WHERE chunk = 1) GROUP BY ALL),
    {topics(f't{d}', f'g{d}', 'subjects', 'session_id, chunk')},
    h{d} AS (SELECT g.*, coalesce(topics, []) AS topics FROM g{d} g LEFT JOIN t{d} USING (session_id, chunk)),
    i{d} AS (SELECT *, {_text(head, 'below[-1]', bullets)} AS summary_text FROM h{d}),
    n{d} AS (SELECT {_id(d, 'nodes')} AS node_id, session_id, {d} AS depth, chunk, event_ids, summary_text, {tokens('summary_text')} AS token_count, CAST(source_tokens AS BIGINT) AS source_token_count,
        'nodes' AS source_type, ids AS source_ids, CAST(n_events AS BIGINT) AS n_events, earliest_at, latest_at, cwd, topics FROM i{d})"""
    return out + ", nodes AS (" + " UNION ALL ".join(f"SELECT {NODE} FROM n{d}" for d in range(depths + 1)) + ")"


def session_summaries() -> str:
    """CTEs after ev (with is_source) that end in summaries."""
    prompt, outcome = "hook_event IN ('UserPromptSubmit', 'Note')", "hook_event IN ('Stop', 'PreCompact', 'PostCompact')"
    kept = "(is_source OR hook_event NOT IN ('UserPromptSubmit', 'Note', 'Stop', 'PreCompact', 'PostCompact')) AND NOT is_own_tool"
    by = "ORDER BY ts, event_id"
    return f""", s0 AS (SELECT session_id, list(ts {by})[-1] AS updated_at, list(cwd {by})[-1] AS cwd, list(hook_event {by})[-1] AS hook,
        coalesce(list(text {by}) FILTER (is_source AND {prompt} AND text <> ''), []) AS prompts, coalesce(list(text {by}) FILTER (is_source AND {outcome} AND text <> ''), []) AS said,
        coalesce(list(event_id {by}) FILTER (is_source), []) AS ids, coalesce(list(tool_name {by}) FILTER (tool_name <> ''), []) AS tools
        FROM ev WHERE {kept} GROUP BY session_id HAVING count(*) FILTER (is_source) > 0),
    {topics('st', 's0', 'list_concat(prompts, said)', 'session_id')},
    s1 AS (SELECT s.*, coalesce(topics, []) AS topics FROM s0 s LEFT JOIN st USING (session_id)),
    summaries AS (SELECT session_id, updated_at, cwd, {title('coalesce(prompts[1], said[1], hook)')} AS title,
        coalesce(nullif(concat_ws(' ', 'User focus: ' || {truncated('prompts[-1]', 220)}, 'Latest outcome: ' || {truncated('said[-1]', 220)}), ''), 'No high-signal user prompt or assistant outcome has been captured yet.') AS overview,
        topics, {head_tail(f"list_transform(prompts, lambda t: {truncated('t', 120)})", 5, 3)} AS key_prompts, list_transform(said, lambda t: {truncated('t', 120)})[-5:] AS outcomes,
        (list_transform(list_filter(list_zip(tools, range(len(tools))), lambda z: list_position(tools, z[1]) = z[2] + 1), lambda z: z[1]))[1:8] AS tools, {head_tail('ids', 12, 6)} AS source_event_ids FROM s1)"""


def hits(x: str, query: str) -> str:
    parts = [f"CAST(contains(lower({x}), '{t}') AS BIGINT)" for t in tx.query_terms(query)]
    return "(" + (" + ".join(parts) or "0") + ")"


def node_title(x: str) -> str:
    lines = f"regexp_split_to_array({x}, '\\r?\\n')"
    bullet = f"list_filter({lines}, lambda l: starts_with(l, '- ') AND regexp_matches(l, '[A-Z0-9][A-Z0-9_-]{{3,}}'))[1]"
    focus = f"list_filter({lines}, lambda l: starts_with(l, 'Focus:'))[1]"
    return title(f"coalesce(regexp_replace({bullet}, '^-\\s*', ''), regexp_replace({focus}, '^Focus:\\s*', ''), {x})")


def directness(x: str, query: str, weight: float) -> str:
    counts = [f"((length(lower({x})) - length(replace(lower({x}), '{t}', ''))) // {len(t)})" for t in tx.query_terms(query)]
    unique = " + ".join(f"CAST({c} > 0 AS BIGINT)" for c in counts)
    return f"(({unique}) * {weight} - least(greatest({' + '.join(counts)} - ({unique}), 0), 6))"


def ranked(query: str) -> str:
    """CTEs after nodes that end in rk: nodes with what ranks them."""
    return f""", rt AS (SELECT *, {node_title('summary_text')} AS heading, array_to_string(topics, ' ') AS subjects FROM nodes),
    rk AS (SELECT *, {hits("concat_ws(chr(10), heading, array_to_string(topics, chr(10)))", query)} AS focused_hits,
        CAST({directness('heading', query, 5.0)} + {directness('subjects', query, 2.5)} AS DOUBLE) AS directness, {hits("concat_ws(chr(10), summary_text, array_to_string(topics, chr(10)))", query)} AS hits,
        round(least(8.0, log2(greatest(len(source_ids), n_events) + 1.0)) * 2 + least(8.0, log2(greatest(1, source_token_count) / 120 + 1)), 4) AS support FROM rt)"""


def matched(name: str, source: str, query: str, k: int) -> str:
    """CTEs that end in `name`: the k best rows of an index for all words of a query, each a single token, by BM25."""
    words = list(dict.fromkeys(re.findall(r"\w+", query.lower())))
    f = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(words))
    some, every = " OR ".join(f"f{i} > 0" for i in range(len(words))), " AND ".join(f"f{i} > 0" for i in range(len(words)))
    idf = ", ".join(f"ln(((SELECT count(*) FROM {name}_a) - count(*) FILTER (f{i} > 0) + 0.5) / (count(*) FILTER (f{i} > 0) + 0.5)) AS i{i}" for i in range(len(words)))
    part = " + ".join(f"(CASE WHEN i{i} <= 0 THEN 1e-6 ELSE i{i} END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(words)))
    return f"""
    {name}_a AS (SELECT *, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{{L}}\\p{{N}}]+') AS w FROM ({source})),
    {name}_b AS (SELECT * EXCLUDE (w), len(w) AS dl, {f} FROM {name}_a),
    {name}_c AS (SELECT * FROM {name}_b WHERE {some}),
    {name}_d AS (SELECT (SELECT sum(dl) FROM {name}_b) / (SELECT count(*) FROM {name}_b) AS avgdl, {idf} FROM {name}_c),
    {name}_e AS (SELECT *, -({part}) AS bm FROM {name}_c, {name}_d WHERE {every}),
    {name} AS (SELECT key, session_id, said, seen, sources, source_tokens, row_number() OVER (ORDER BY round(bm, 9), depth DESC, seen DESC, key) AS place FROM {name}_e QUALIFY place <= {k})"""


def search(query: str, exclude: tuple[str, ...] = (), limit: int = 10) -> str:
    """CTEs after nodes and summaries that end in the best sessions."""
    k = max(limit * 20, 50)
    words = {w.strip("-") for w in re.split(r"[^\w-]+", query.lower())}
    broad = sum(len(w) >= 3 or bool(re.search(r"[-_\d]", w)) for w in words) >= 4
    out = "WHERE session_id NOT IN (" + ", ".join(f"'{s}'" for s in exclude) + ")" if exclude else ""
    fields = "concat_ws(chr(10), session_id, cwd, coalesce(repo_root, ''), "
    n = f"SELECT node_id AS key, session_id, {fields.replace('repo_root', 'NULL')} depth, summary_text, array_to_string(topics, chr(10)), array_to_string(event_ids, chr(10))) AS text, summary_text AS said, latest_at AS seen, depth, n_events AS sources, source_token_count AS source_tokens FROM nodes"
    text = "concat_ws(chr(10), title, overview, array_to_string(topics, chr(10)), array_to_string(key_prompts, chr(10)), array_to_string(outcomes, chr(10)), array_to_string(tools, chr(10)))"
    s = f"SELECT session_id AS key, session_id, concat_ws(chr(10), cwd, {text}) AS text, {text} AS said, updated_at AS seen, 0 AS depth, CAST(len(source_event_ids) AS BIGINT) AS sources, 0 AS source_tokens FROM summaries"
    e = f"SELECT event_id AS key, session_id, {fields} hook_event, text) AS text, text AS said, ts AS seen, 0 AS depth, 0 AS sources, 0 AS source_tokens FROM ev"
    kinds = [("mn", n, "summary_node", 4, 3, 0), ("ms", s, "session_summary", 3, 2, k), ("me", e, "event", 1, 1, 2 * k)]
    parts = ",".join(matched(name, source, query, k) for name, source, *_ in kinds)
    union = " UNION ALL ".join(f"SELECT '{kind}' AS kind, {order} AS kind_order, * EXCLUDE (said, place), {hits('said', query)} * {weight} AS row_score, place + {first} AS first FROM {name}" for name, _, kind, weight, order, first in kinds)
    best = "row_score DESC, seen DESC, first"
    return f""", {parts},
    c0 AS (SELECT * FROM ({union}) {out}),
    c1 AS (SELECT session_id, kind, sum(row_score) AS score, count(*) AS match_count, max(seen) AS last_match_at, max(row_score) AS best_score, min(first) AS first, any_value(kind_order) AS kind_order,
        list(key ORDER BY {best})[1] AS best_key, list(sources ORDER BY {best})[1] AS sources, list(source_tokens ORDER BY {best})[1] AS source_tokens FROM c0 GROUP BY session_id, kind),
    c2 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score DESC, match_count DESC, kind_order DESC) = 1),
    c3 AS (SELECT c.*, e.event_count FROM c2 c JOIN (SELECT session_id, count(*) AS event_count FROM ev GROUP BY session_id) e USING (session_id)),
    c4 AS (SELECT *, CAST(score + CASE kind WHEN 'summary_node' THEN 10 WHEN 'session_summary' THEN 6 ELSE 0 END + CASE WHEN sources >= 4 THEN 12 WHEN sources >= 2 THEN 6 ELSE 0 END
        + CASE WHEN source_tokens >= 600 THEN 8 WHEN source_tokens >= 160 THEN 4 ELSE 0 END + CASE WHEN event_count >= 8 THEN 8 WHEN event_count >= 3 THEN 4 WHEN event_count >= 2 THEN 2 ELSE 0 END
        + CASE WHEN match_count >= 2 THEN least(match_count, 4) * 2 ELSE 0 END {"- CASE WHEN event_count <= 1 THEN 24 ELSE 0 END" if broad else ""} AS BIGINT) AS discovery_score FROM c3)
    SELECT session_id, kind, CAST(score AS BIGINT) AS score, match_count, last_match_at, best_key, discovery_score, CASE WHEN discovery_score >= 34 THEN 'high' WHEN discovery_score >= 18 THEN 'medium' ELSE 'low' END AS confidence
    FROM c4 ORDER BY discovery_score DESC, score DESC, best_score DESC, match_count DESC, last_match_at DESC, first LIMIT {limit}"""
