"""Vector codes of a product quantiser, trained and assigned by Exponion search in exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, save, sized
from .vectors import integer_rows, squares, stacked

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Neighbour entries that are looked at first; each further stretch of the list is four times as long.
FIRST_STRETCH = 16


class Codebook:
    """Entries (k, width) of one part, each with all entries in the order of their distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        between = squares(entries, entries)
        self.near = np.argsort(between, axis=1, kind="stable")
        self.away = np.sqrt(np.take_along_axis(between, self.near, axis=1).astype(np.float64))

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x its nearest entry, the lower index at equal distances, and the squared distance.

        Let a row be at distance u from its start. Any entry at distance v or less from the row is at most
        u + v from the start. With v = u, the start's own distance, a radius of 2 u about the start holds
        the nearest entry and all that tie with it; the radius shrinks as v does. Only the start's list up
        to the radius is scanned. Distances are compared as integers; the radius, a float, is widened by far
        more than its rounding.
        """
        best, least = start.copy(), ((x - self.entries[start]) ** 2).sum(axis=1)
        first = np.sqrt(least.astype(np.float64))
        order = np.argsort(start, kind="stable")
        cuts = np.flatnonzero(np.diff(start[order])) + 1
        for rows in np.split(order, cuts) if len(order) else ():
            near, away = self.near[start[rows[0]]], self.away[start[rows[0]]]
            at, step = 0, FIRST_STRETCH
            while at < len(near):
                radius = (first[rows] + np.sqrt(least[rows].astype(np.float64))) * (1 + 1e-9) + 1e-9
                rows = rows[radius >= away[at]]
                if not len(rows):
                    break
                some = near[at : at + step]
                d = squares(x[rows], self.entries[some])
                low = d.min(axis=1)
                index = np.where(d == low[:, None], some[None, :], len(near)).min(axis=1)
                better = (low < least[rows]) | ((low == least[rows]) & (index < best[rows]))
                best[rows[better]], least[rows[better]] = index[better], low[better]
                at, step = at + step, step * 4
        return best, least


def _cut(x: np.ndarray) -> list[np.ndarray]:
    """The consecutive parts, equal where the length allows it."""
    return np.array_split(x, PARTS, axis=1)


def _assign(entries: list[np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each row's entries, searched for from those it had before (from the first ones at the start)."""
        books = [Codebook(e) for e in entries]
        for pdf in batches:
            if not len(pdf):
                continue
            old = np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(-1, PARTS).astype(np.int64)
            found = [b.nearest(x, old[:, i]) for i, (b, x) in enumerate(zip(books, _cut(stacked(pdf["x"])), strict=True))]
            code = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            yield pdf.assign(code=[c.tobytes() for c in code], error=sum(f[1] for f in found))

    return run


def _sums(widths: list[int], entries: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task's sums and counts of each part's entries."""
        total = [np.zeros((entries, w + 1), np.int64) for w in widths]
        for pdf in batches:
            if not len(pdf):
                continue
            code = np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(-1, PARTS)
            for i, x in enumerate(_cut(stacked(pdf["x"]))):
                np.add.at(total[i], code[:, i], np.hstack([x, np.ones((len(x), 1), np.int64)]))
        for i, t in enumerate(total):
            used = np.flatnonzero(t[:, -1])
            yield pd.DataFrame({"part": np.full(len(used), i), "entry": used, "sums": [row.tolist() for row in t[used]]})

    return run


def train(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, list[np.ndarray]]:
    """rows (vec_id, label, x) with code and error, and the entries of each part.

    The entries start as the parts of the rows of the smallest ids (null ids last, equal ids by their vectors).
    Every round assigns all rows, writes them with their codes, and adds up tasks' sums for each entry;
    what the driver holds are the entries alone, and of the written tables only the newest is kept.
    """
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").toPandas()
    if not len(start):
        empty = rows.withColumn("code", F.lit(None).cast("binary")).withColumn("error", F.lit(None).cast("long"))
        return empty, [np.empty((0, 0), np.int64)] * PARTS
    books = _cut(stacked(start["x"]))
    schema = f"vec_id long, label {dict(rows.dtypes)['label']}, x array<int>, code binary, error long"
    coded = rows.withColumn("code", F.unhex(F.lit("00" * PARTS)))
    before = None
    for left in range(rounds, -1, -1):
        coded = save(coded.select("vec_id", "label", "x", "code").mapInPandas(_assign(books), schema), "coded")
        if before is not None:
            discard(before)
        before = coded
        if left:
            sums = coded.select("x", "code").mapInPandas(_sums([b.shape[1] for b in books], entries), "part int, entry int, sums array<long>")
            sums = sums.select("part", "entry", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("s").alias("s"))
            whole = sums.groupBy("part", "entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda c: c["s"]).alias("sums"))
            books = [b.copy() for b in books]
            for part, entry, values in whole.collect():
                books[part][entry] = np.array(values[:-1], np.int64) // values[-1]
    return coded, books


def compress(vectors: DataFrame, scale: int = SCALE, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """Codes of vectors (vec_id, embedding, label): PARTS bytes each, one for each consecutive part.

    Components become floor(scale * component). Rows whose vector is null or holds a null or non-finite
    component are dropped, and those that integer_rows names as out of range or of another length. Rows with
    null or repeated ids and repeated rows are rows like any other; null labels are one label. With fewer
    rows than `entries` (256 at most) there are as many entries as rows. Entries' means are rounded down. An
    empty table gives an empty result; other columns are ignored.

    Returns vec_id, code (two hex digits a part), error (squared distance to the entries, summed over the
    parts), label_error (summed over the label) and codebooks_sha256 (of all final entries' integers).
    """
    assert 1 <= entries <= 256
    coded, books = train(integer_rows(vectors, scale, "label"), rounds, entries)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    by_label = save(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "labels")
    out = coded.join(sized(by_label, 64), F.col("label").eqNullSafe(F.col("of_label")), "left")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
