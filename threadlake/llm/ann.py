"""Approximate nearest neighbours on robust-pruned directed graphs, one graph for each shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import blocks_for, salt, save

#: Distinct vectors in a shard, edges of a node, width of the beam while building and searching, and
#: how much nearer (squared) an edge's end has to be to make another edge needless.
SHARD_VECTORS = 8192
DEGREE = 32
BUILD_BEAM = 48
SEARCH_BEAM = 96
RELAX = 1.2
#: Queries that one beam search advances together.
QUERY_BATCH = 256


class Graph:
    """A directed graph over unit-lifted vectors; squared Euclidean distance orders like inner product."""

    def __init__(self, vectors: np.ndarray, norm: float, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX):
        x = vectors.astype(np.float32)
        lift = np.sqrt(np.maximum(0, norm * norm - np.einsum("ij,ij->i", x, x)))  # one more component: all norms equal
        self.x = np.hstack([x, lift[:, None].astype(np.float32)])
        self.n, self.degree, self.relax = len(x), degree, relax
        self.edges = np.full((self.n, 2 * degree), -1, np.int32)  # full rows are pruned back to degree
        if self.n:
            centre = self.x.mean(axis=0)
            self.entry = int(((self.x - centre) ** 2).sum(axis=1).argmin())
            self._build(beam)

    def _build(self, beam: int) -> None:
        """Insert in batches that double; at the end prune every node to its degree."""
        order = np.random.default_rng(7).permutation(self.n)
        order = np.concatenate([[self.entry], order[order != self.entry]])
        done = 1
        while done < self.n:
            batch = order[done : min(self.n, done + min(done, QUERY_BATCH))]
            self._insert(batch, beam)
            done += len(batch)
        for node in np.flatnonzero((self.edges >= 0).sum(axis=1) > self.degree).tolist():
            own = self.edges[node]
            kept = self._prune(node, own[own >= 0])
            self.edges[node] = -1
            self.edges[node, : len(kept)] = kept
        self.edges = self.edges[:, : self.degree]

    def _insert(self, batch: np.ndarray, beam: int) -> None:
        found, _ = self.search(self.x[batch], beam)
        reverse: dict[int, list[int]] = {}
        for node, near in zip(batch.tolist(), found, strict=True):
            kept = self._prune(node, np.concatenate([near[near >= 0], self.edges[node][self.edges[node] >= 0]]))
            self.edges[node] = -1
            self.edges[node, : len(kept)] = kept
            for k in kept.tolist():
                reverse.setdefault(k, []).append(node)
        for node, more in reverse.items():
            own = self.edges[node][self.edges[node] >= 0]
            new = np.setdiff1d(np.array(more, np.int32), own)
            if len(own) + len(new) <= self.edges.shape[1]:
                self.edges[node, len(own) : len(own) + len(new)] = new
            else:
                kept = self._prune(node, np.concatenate([own, new]))
                self.edges[node] = -1
                self.edges[node, : len(kept)] = kept

    def _prune(self, node: int, near: np.ndarray) -> np.ndarray:
        """Nearest first, keep an edge unless a kept one's end is nearer to it by the relaxed factor."""
        near = np.unique(near)
        near = near[near != node]
        x = self.x[near] - self.x[node]  # seen from the node, so that a common large component cancels first
        far = (x**2).sum(axis=1)
        by = np.argsort(far, kind="stable")
        near, far, x = near[by], far[by], x[by]
        dots = x @ x.T
        square = np.diag(dots)
        between = (square[:, None] + square[None, :] - 2 * dots) * self.relax
        alive = np.ones(len(near), bool)
        kept: list[int] = []
        for i in range(len(near)):
            if alive[i]:
                kept.append(i)
                if len(kept) == self.degree:
                    break
                alive &= between[i] > far
        return near[kept]

    def search(self, queries: np.ndarray, beam: int, inner: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Beam search from the entry for each lifted query: node ids (-1: none), nearest first, and distances.

        inner: order by the largest inner product instead, which is the same order for queries of lift 0 but
        keeps its precision where one vector is far longer than the others.
        """

        def away(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return -np.einsum("ij,ij->i", x, y) if inner else ((x - y) ** 2).sum(axis=1)

        q = queries.astype(np.float32)
        ids = np.full((len(q), beam), -1, np.int32)
        dist = np.full((len(q), beam), np.inf, np.float32)
        open_ = np.zeros((len(q), beam), bool)
        seen = np.zeros((len(q), self.n), bool)
        ids[:, 0], open_[:, 0] = self.entry, True
        dist[:, 0] = away(q, np.broadcast_to(self.x[self.entry], q.shape))
        seen[:, self.entry] = True
        while True:
            live = np.flatnonzero(open_.any(axis=1))
            if not len(live):
                return ids, dist
            at = open_[live].argmax(axis=1)  # beams are sorted: the first open node is the nearest
            open_[live, at] = False
            near = self.edges[ids[live, at]]
            new = (near >= 0) & ~seen[live[:, None], near]
            r, c = np.nonzero(new)
            if not len(r):
                continue
            seen[live[r], near[r, c]] = True
            d = np.full(near.shape, np.inf, np.float32)
            d[r, c] = away(self.x[near[r, c]], q[live[r]])
            all_d = np.concatenate([dist[live], d], axis=1)
            all_i = np.concatenate([ids[live], np.where(new, near, -1)], axis=1)
            all_o = np.concatenate([open_[live], new], axis=1)
            by = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[live] = np.take_along_axis(all_d, by, axis=1)
            ids[live] = np.take_along_axis(all_i, by, axis=1)
            open_[live] = np.take_along_axis(all_o, by, axis=1)
        return ids, dist

    def lifted(self, queries: np.ndarray) -> np.ndarray:
        return np.hstack([queries.astype(np.float32), np.zeros((len(queries), 1), np.float32)])


def _index(norm: float, degree: int, beam: int, relax: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", ignore_index=True)
        g = Graph(np.array(pdf["vector"].tolist(), np.float64).reshape(len(pdf), -1), norm, degree, beam, relax)
        return pd.DataFrame({"shard": pdf["shard"], "node": np.arange(len(pdf)), "rep": pdf["rep"], "vector": pdf["vector"], "edges": [e[e >= 0].tolist() for e in g.edges], "entry": g.entry})

    return run


def _search(norm: float, k: int, beam: int):
    def run(_key, left: pd.DataFrame, right: Iterator | pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(left) or not len(right):
            return empty
        left = left.sort_values("node", ignore_index=True)
        exact = np.array(left["vector"].tolist(), np.float64)
        g = Graph(exact[:0], norm)
        lift = np.sqrt(np.maximum(0, norm * norm - np.einsum("ij,ij->i", exact, exact)))
        g.x = np.hstack([exact, lift[:, None]]).astype(np.float32)
        g.n, g.entry = len(exact), int(left["entry"][0])
        g.edges = np.full((g.n, max(1, left["edges"].map(len).max())), -1, np.int32)
        for i, e in enumerate(left["edges"]):
            g.edges[i, : len(e)] = e
        reps = left["rep"].to_numpy()
        out = []
        for at in range(0, len(right), QUERY_BATCH):
            part = right.iloc[at : at + QUERY_BATCH]
            q = np.array(part["vector"].tolist(), np.float64)
            ids, _ = g.search(g.lifted(q), max(beam, 2 * k), inner=True)
            # k + 1: one of a query's results may be the query's own vector
            score = np.where(ids >= 0, (exact[ids] * q[:, None, :]).sum(axis=2), -np.inf)
            by = np.lexsort((reps[ids], -score), axis=1)[:, : k + 1]
            ok = np.take_along_axis(ids, by, axis=1) >= 0
            out.append(pd.DataFrame({"query_id": np.repeat(part["query_id"].to_numpy(), by.shape[1])[ok.ravel()], "rep": reps[np.take_along_axis(ids, by, axis=1)][ok], "score": np.take_along_axis(score, by, axis=1)[ok]}))
        return pd.concat(out) if out else empty

    return run


def nearest(
    vectors: DataFrame,
    every: int,
    k: int,
    shard_vectors: int = SHARD_VECTORS,
    degree: int = DEGREE,
    build_beam: int = BUILD_BEAM,
    beam: int = SEARCH_BEAM,
    relax: float = RELAX,
) -> DataFrame:
    """The k rows of vectors (vec_id, embedding) with the largest inner product, for each row whose id `every` divides.

    Rows with a null id, or a vector that is null, all zero or holds a null or non-finite component, take no
    part. Equal vectors are indexed once: of their rows only the k + 1 smallest ids can be among any k nearest,
    so each distinct vector keeps those, found by partial lists in salted groups; hot vectors make no hot task.
    Repeated ids count as one row for each distinct vector. Distinct vectors are dealt to shards of about
    `shard_vectors`; each shard's graph is built and written once, then all queries search every shard, and the
    shards' results are merged. Vectors of another length than most rows have (the longer one of two that are as
    frequent) take no part. An empty table gives an empty result; other columns are ignored.

    Returns query_id, rank (from 1), vec_id, score (inner product in double precision).
    """
    v = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    v = v.where("vec_id is not null and vector is not null").where(~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))
    v = v.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))  # -0.0 equals 0.0
    v = save(v.withColumn("key", F.md5(F.to_json("vector"))), "vectors")
    common = v.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    v = v.where(F.size("vector") == (common["length"] if common else 0))
    n = v.count()
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    norm = float(v.agg(F.max(F.sqrt(square))).first()[0] or 0.0)
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    parts = blocks_for(n, 4096)
    # A salted group holds at most about 4096 ids, a merged one parts * (k + 1) at most.
    some = v.groupBy("key", salt(F.col("vec_id"), parts).alias("part")).agg(least(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector"))
    groups = some.groupBy("key").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"), F.first("vector").alias("vector"))
    groups = save(groups.select(F.col("ids")[0].alias("rep"), "ids", "vector", "key"), "groups")
    shards = blocks_for(groups.count(), shard_vectors)
    dealt = groups.select(salt(F.col("key"), shards).alias("shard"), "rep", "vector")
    index = dealt.groupBy("shard").applyInPandas(
        _index(norm, degree, build_beam, relax), "shard int, node int, rep long, vector array<double>, edges array<int>, entry int"
    )
    index = save(index, "index")
    queries = v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector", "key")
    q_parts = blocks_for(queries.count(), 16_384)
    # Each shard's graph is read by as many tasks as there are blocks of queries.
    to = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asked = queries.select(to, salt(F.col("query_id"), q_parts).alias("block"), "query_id", "vector")
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))))
    found = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(_search(norm, k, beam), "query_id long, rep long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    found = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    rows = found.join(groups.select("rep", F.explode("ids").alias("vec_id")), "rep").where("vec_id <> query_id")
    rows = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
