"""Chat transcripts: roles of lines by a hidden Markov model, then canonical turns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import save

#: Speakers; all that are none of the first three count as tools.
ROLES = ["system", "user", "assistant", "tool"]
#: States: each role's first line of a turn, and its further lines.
STATES = [(r, p) for r in ROLES for p in ("first", "further")]
#: What a line's marker may say, in this order; 0 is none.
MARKERS = {
    "system": r"^\s*[\[#*(<|]*\s*(system|instructions?)\s*[\])*>|]*\s*[:>\]]",
    "user": r"^\s*[\[#*(<|]*\s*(user|human|me|question|q)\s*[\])*>|]*\s*[:>\]]",
    "assistant": r"^\s*[\[#*(<|]*\s*(assistant|ai|bot|answer|a)\s*[\])*>|]*\s*[:>\]]",
    "tool": r"^\s*[\[#*(<|]*\s*(tool|function|observation|result)\s*[\])*>|]*\s*[:>\]]",
}
#: Values of the features: marker, after a blank line or at the start, length, ends in a question mark.
SIZES = (5, 3, 4, 2)
#: Lines, or groups of lines, that one task of a level takes in turn.
SEGMENT = 512


def features(text: Column, before: Column) -> Column:
    """A line's features as one array of small numbers; before: the line before it, null at the start."""
    low = F.lower(text)
    marker = F.lit(0)
    for i, role in reversed(list(enumerate(ROLES, 1))):
        marker = F.when(low.rlike(MARKERS[role]), i).otherwise(marker)
    gap = F.when(before.isNull(), 2).when(F.trim(before) == "", 1).otherwise(0)
    n = F.length(text)
    size = F.when(n == 0, 0).when(n < 80, 1).when(n < 240, 2).otherwise(3)
    return F.array(marker, gap, size, F.rtrim(text).endswith("?").cast("int"))


def with_before(rows: DataFrame, *names: str) -> DataFrame:
    """rows (conv_id, line_no from 0 without gaps, ...) with before_<name> of the line before, null at the start.

    Conversations are cut in segments of SEGMENT lines; a segment's last line goes to the next one too, so
    that a hot conversation is many groups.
    """
    own = F.floor(F.col("line_no") / SEGMENT)
    ends = F.col("line_no") % SEGMENT == SEGMENT - 1
    rows = rows.withColumn("__segment", F.explode(F.when(ends, F.array(own, own + 1)).otherwise(F.array(own))))
    order = Window.partitionBy("conv_id", "__segment").orderBy("line_no")
    rows = rows.select("*", *[F.lag(c).over(order).alias(f"before_{c}") for c in names])
    return rows.where(F.col("__segment") == own).drop("__segment")


def with_running(rows: DataFrame, flag: str, name: str) -> DataFrame:
    """rows with the number of flagged lines up to each; segments are counted first, as in with_before."""
    rows = rows.withColumn("__segment", F.floor(F.col("line_no") / SEGMENT))
    counts = rows.groupBy("conv_id", "__segment").agg(F.count_if(flag).alias("__n"))
    ahead = Window.partitionBy("conv_id").orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("conv_id", "__segment", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    order = Window.partitionBy("conv_id", "__segment").orderBy("line_no")
    rows = rows.withColumn(name, F.sum(F.col(flag).cast("long")).over(order)).join(start, ["conv_id", "__segment"])
    return rows.withColumn(name, F.col(name) + F.col("__start")).drop("__segment", "__start")


def held_out(conv_id: Column) -> Column:
    """Whether a conversation is one of the quarter that the model never learns from."""
    return F.pmod(F.xxhash64(F.lit("held out"), conv_id), F.lit(4)) == 2


@dataclass
class Hmm:
    """Log probabilities: first state, next state, and each feature's value in each state."""

    start: np.ndarray
    step: np.ndarray
    emit: list[np.ndarray]

    def matrix(self, seen: np.ndarray) -> np.ndarray:
        """log P(seen line, state | state before) for each line: lines x states x states."""
        out = sum(e[:, seen[:, k]] for k, e in enumerate(self.emit))
        return self.step[None, :, :] + np.ascontiguousarray(out.T)[:, None, :]

    def first(self, seen: np.ndarray) -> np.ndarray:
        return self.start + sum(e[:, seen[k]] for k, e in enumerate(self.emit))


def fit(lines: DataFrame) -> Hmm:
    """Count an Hmm from labelled lines (conv_id, line_no from 0 without gaps, line, state); counts start at 1.

    Rows with a null state or line are passed over. Counts are sums over all rows; what reaches the driver
    is one row for each state and feature value.
    """
    seen = with_before(lines.select("conv_id", "line_no", "line", "state"), "state", "line").where("state is not null and line is not null")
    seen = seen.select("state", F.col("before_state").alias("past"), features(F.col("line"), F.col("before_line")).alias("f"))
    s = len(STATES)
    start, step, emit = np.ones(s), np.ones((s, s)), [np.ones((s, k)) for k in SIZES]
    for r in seen.groupBy("past", "state").count().collect():
        if r["past"] is None:
            start[r["state"]] += r["count"]
        else:
            step[r["past"], r["state"]] += r["count"]
    for r in seen.select("state", F.posexplode("f")).groupBy("state", "pos", "col").count().collect():
        emit[r["pos"]][r["state"], r["col"]] += r["count"]
    norm = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return Hmm(norm(start), norm(step), [norm(e) for e in emit])


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole runs of equal keys from sorted batches; a run has at most SEGMENT rows."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        pdf = pd.concat([*held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        change = (pdf[keys].iloc[1:].to_numpy() != pdf[keys].iloc[:-1].to_numpy()).any(axis=1)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(pdf)]
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield pdf.iloc[a:b]
        held = [pdf.iloc[cuts[-2] :]]
    yield from (h for h in held if len(h))


def _matrices(hmm: Hmm | None, pdf: pd.DataFrame) -> np.ndarray:
    """Each row's matrix; a line that starts a transcript enters from a virtual state, put in every row."""
    s = len(STATES)
    if hmm is None:
        return np.array(pdf["m"].tolist()).reshape(-1, s, s)
    seen = np.array(pdf["f"].tolist(), int)
    m = hmm.matrix(seen)
    for i in np.flatnonzero(pdf["line_no"].to_numpy() == 0):
        m[i] = hmm.first(seen[i])[None, :]
    return m


def _up(hmm: Hmm | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Max-plus product of each group's matrices."""
        out = []
        for g in _runs(batches, ["conv_id", "up"]):
            ms = _matrices(hmm, g)
            total = ms[0]
            for m in ms[1:]:
                total = (total[:, :, None] + m[None, :, :]).max(axis=1)
            out.append((g["conv_id"].iloc[0], g["up"].iloc[0], total.ravel().tolist()))
            if len(out) == 1000:
                yield pd.DataFrame(out, columns=["conv_id", "line_no", "m"])
                out = []
        yield pd.DataFrame(out, columns=["conv_id", "line_no", "m"])

    return run


def _down(hmm: Hmm | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each row's state before and after, given those of its group: Viterbi within the group."""
        out = []
        for g in _runs(batches, ["conv_id", "up"]):
            ms = _matrices(hmm, g)
            best, back = ms[0][int(g["enter"].iloc[0])], []
            for m in ms[1:]:
                all_ = best[:, None] + m
                back.append(all_.argmax(axis=0))
                best = all_.max(axis=0)
            path = [int(g["leave"].iloc[0])]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            path.reverse()
            out.append(pd.DataFrame({"conv_id": g["conv_id"], "line_no": g["line_no"], "enter": [int(g["enter"].iloc[0]), *path[:-1]], "leave": path}))
            if len(out) == 1000:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)

    return run


def viterbi(lines: DataFrame, hmm: Hmm) -> DataFrame:
    """The best state of each line (conv_id, line_no from 0 without gaps, f): conv_id, line_no, state.

    Lines are taken in segments of SEGMENT. Going up, a segment becomes the max-plus product of its lines'
    matrices, and segments of segments likewise, until each transcript is one matrix; going down, the
    states at the ends of a segment fix the best path within it. A transcript of any length is thus work
    for many bounded tasks.
    """
    grouped = lambda d: d.withColumn("up", F.floor(F.col("line_no") / SEGMENT)).repartition("conv_id", "up").sortWithinPartitions("conv_id", "up", "line_no")
    levels = [save(lines.select("conv_id", "line_no", "f"), "level")]
    while True:
        model = hmm if len(levels) == 1 else None
        up = grouped(levels[-1]).mapInPandas(_up(model), "conv_id long, line_no long, m array<double>")
        levels.append(save(up, "level"))
        if not levels[-1].where("line_no > 0").limit(1).count():
            break
    s = len(STATES)
    last = F.slice("m", 1, s)  # the start's row: all rows are equal
    ends = levels[-1].select("conv_id", F.col("line_no").alias("up"), F.lit(0).alias("enter"), (F.array_position(last, F.array_max(last)) - 1).cast("int").alias("leave"))
    for i in range(len(levels) - 2, -1, -1):
        model = hmm if i == 0 else None
        below = levels[i].withColumn("up", F.floor(F.col("line_no") / SEGMENT)).join(ends, ["conv_id", "up"])
        below = below.repartition("conv_id", "up").sortWithinPartitions("conv_id", "up", "line_no")
        found = below.mapInPandas(_down(model), "conv_id long, line_no long, enter int, leave int")
        if i == 0:
            return found.select("conv_id", "line_no", F.col("leave").alias("state"))
        ends = save(found.withColumnRenamed("line_no", "up"), "ends")


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with line_no, from 0 without gaps in each key; a hot key is spread over range partitions."""
    cut = rows.repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id())
    cut = save(cut, "cut")
    counts = cut.groupBy(key, "__part").count()
    ahead = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select(key, "__part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy(key, "__part").orderBy(*order))
    return cut.withColumn("line_no", place).join(start, [key, "__part"]).withColumn("line_no", F.col("__start") + F.col("line_no") - 1).drop("__part", "__start")


def transcripts(turns: DataFrame) -> DataFrame:
    """Raw transcript lines of turns (conv_id, turn, role, text), with their true states.

    A conversation writes its speakers in one of four styles. A third of all turns but the first, chosen
    by hash, have lost their marker and start after a blank line only. Turns whose conv_id or turn is null
    are left out; a role that is null or not one of ROLES is written as a tool's; a null text is an empty
    line; of turns that share a number, all stay, in the order of role and text.
    """
    style = F.pmod(F.xxhash64(F.lit("style"), "conv_id"), F.lit(4))
    said = {"system": ("System", "Instructions"), "user": ("User", "Human"), "assistant": ("Assistant", "AI"), "tool": ("Tool", "Function")}
    role = F.col("role")

    def name(i: int) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for r in ROLES for x in (r, said[r][i])]), role)

    marker = F.when(style == 0, F.concat(name(0), F.lit(": "))).when(style == 1, F.concat(F.lit("### "), name(1), F.lit(": "))).when(style == 2, F.concat(F.lit("["), F.lower(name(0)), F.lit("] "))).otherwise(F.concat(F.lit("<|"), F.lower(name(1)), F.lit("|>: ")))
    lost = (F.col("turn") > 0) & (F.pmod(F.xxhash64(F.lit("lost"), "conv_id", "turn"), F.lit(3)) == 0)
    rows = turns.where("conv_id is not null and turn is not null").withColumn("role", F.when(role.isin(*ROLES), role).otherwise("tool"))
    rows = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.when(lost, F.lit("")).otherwise(marker).alias("marker"))
    parts = F.split(F.concat(F.when(F.col("turn") > 0, F.lit("\n")).otherwise(F.lit("")), "marker", "text"), "\n")
    rows = rows.select("conv_id", "turn", "role", "text", F.posexplode(parts).alias("k", "line"))
    rows = with_before(numbered(rows, "conv_id", "turn", "role", "text", "k").drop("text"), "role")
    state = lambda r: 2 * (F.array_position(F.array(*[F.lit(x) for x in ROLES]), r) - 1)
    # The blank line between two turns belongs to the turn before it, as a further line.
    blank = (F.col("turn") > 0) & (F.col("k") == 0)
    first = F.col("k") == F.when(F.col("turn") > 0, 1).otherwise(0)
    own = state(role) + F.when(first, 0).otherwise(1)
    return rows.select("conv_id", "line_no", "line", F.when(blank, state(F.coalesce("before_role", "role")) + 1).otherwise(own).cast("int").alias("state"))


def escaped(text: Column) -> Column:
    """A text in which no marker can begin: a backslash more between < and |, however many stand there."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def parse(lines: DataFrame, hmm: Hmm) -> DataFrame:
    """Canonical turns of transcript lines (conv_id, line_no, line).

    Returns conv_id, turn (from 0), role, text (without marker and outer blank lines), n_lines, rendered,
    whose text is escaped so that it holds no marker of its own, and held_out (whether fit() should not have
    seen the conversation). Rows with a null conv_id or line_no are left out, a null line is an empty one, and
    repeated line numbers all stay, in the order of their text. An empty table gives an empty result; other
    columns are ignored. A conversation of any length is many tasks; one turn's text is put together in one place.
    """
    rows = lines.where("conv_id is not null and line_no is not null").select("conv_id", F.col("line_no").alias("at"), F.coalesce("line", F.lit("")).alias("line"))
    rows = with_before(numbered(rows, "conv_id", "at", "line"), "line")
    rows = save(rows.select("conv_id", "line_no", "line", features(F.col("line"), F.col("before_line")).alias("f")), "lines")
    states = viterbi(rows, hmm)
    said = rows.select("conv_id", "line_no", "line").join(states, ["conv_id", "line_no"])
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.floor(F.col("state") / 2).cast("int") + 1)
    said = with_before(said.withColumn("role", role), "role")
    starts = (F.col("state") % 2 == 0) | (F.col("line_no") == 0) | (F.col("role") != F.col("before_role"))
    said = with_running(save(said.withColumn("starts", starts), "said"), "starts", "turn").withColumn("turn", F.col("turn") - 1)
    marked = "|".join(f"({m})" for m in MARKERS.values())
    line = F.when(F.col("state") % 2 == 0, F.regexp_replace("line", f"(?i)({marked})\\s?", "")).otherwise(F.col("line"))
    turns = said.groupBy("conv_id", "turn").agg(
        F.min("role").alias("role"), F.sort_array(F.collect_list(F.struct("line_no", line.alias("line")))).alias("lines")
    )
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    text = F.regexp_replace(text, r"^\n+|\n+$", "")
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", text.alias("text"), F.size("lines").cast("long").alias("n_lines"))
    rendered = F.concat(F.lit("<|"), "role", F.lit("|>\n"), escaped(F.col("text")), F.lit("<|end|>\n"))
    return turns.withColumn("rendered", rendered).withColumn("held_out", held_out(F.col("conv_id")))
