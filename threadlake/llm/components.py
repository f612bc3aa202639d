"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save

#: Edges that are thinned out at a time.
CHUNK = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    """Edges that join the same nodes as the given ones: each node, but the smallest of its set, with that one."""
    node, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    low = np.arange(len(node))
    while len(a):
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], least)
        np.minimum.at(low, low[b], least)
        while (low[low] != low).any():
            low = low[low]
        open_ = low[a] != low[b]
        a, b = a[open_], b[open_]
    far = low != np.arange(len(node))
    return pd.DataFrame({"u": node[far], "v": node[low[far]]})


def _thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= CHUNK:
            both = pd.concat(held)
            held = []
            yield forest(both["u"].to_numpy(), both["v"].to_numpy())
    if held:
        both = pd.concat(held)
        yield forest(both["u"].to_numpy(), both["v"].to_numpy())


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Label each node of edges (a, b: long) with the smallest node of its component.

    Returns (node, root) for nodes that have an edge. Null ends and loops are ignored, repeated
    edges count once, an empty table gives an empty result. First, edges are dealt by ranges of both ends,
    so that a node's edges are near each other but never one task's alone, and each chunk keeps a spanning
    forest: what then goes round is at most one edge for each node and chunk. Each round moves every edge
    towards smaller nodes in two shuffles; nodes with many edges are handled by aggregation with partial
    sums and joins that adaptive execution can split, never by collecting a neighbourhood.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = e.where("u is not null and v is not null and u <> v").repartitionByRange("u", "v")
    e = save(save(e.mapInPandas(_thin, "u long, v long"), "thin").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        # Large star: every larger neighbour of a node hangs on the node's smallest neighbour.
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("n").agg(F.min("m").alias("low"))
        least = least.select("n", F.least("n", "low").alias("low"))
        large = (
            both.where("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        )
        # Small star: every smaller neighbour, and the node, hangs on the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u")
        moved = (
            small.select(F.greatest("v", "low").alias("u"), F.least("v", "low").alias("v"))
            .union(low.select("u", F.col("low").alias("v")))
            .where("u <> v")
            .distinct()
        )
        e = save(moved, "edges")
        now = e.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return save(e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), "roots")
