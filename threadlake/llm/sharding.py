"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import blocks_for, salt, save, text_or_empty

#: Groups that one differencing task holds, and partial partitions that one task of the next level joins.
BLOCK_GROUPS = 20_000
FAN_IN = 512
#: Rows between two slot offsets within a shard.
SLOT_ROWS = 50_000


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (one row of bin sums each) until one is left.

    The two with the largest spread are combined in opposite orders, again and again. Returns the
    sums of the final bins, and for each part and each of its bins the final bin it went to.
    """
    n, k = parts.shape
    order = np.argsort(-parts, axis=1, kind="stable")
    sums = list(np.take_along_axis(parts, order, axis=1))
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []  # two nodes and the order of the new node's bins
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        rank = np.argsort(-total, kind="stable")
        sums[a] = sums[b] = None  # type: ignore[call-overload]
        total = total[rank]
        merges.append((a, b, rank.astype(np.int32)))
        sums.append(total)
        heapq.heappush(heap, (-int(total[0] - total[-1]), len(sums) - 1))
    label = [np.arange(k, dtype=np.int32)] * len(sums)
    for i in range(len(merges) - 1, -1, -1):
        a, b, rank = merges[i]
        own = np.empty(k, np.int32)
        own[rank] = label[n + i]
        label[a], label[b] = own, own[::-1]
    out = np.empty((n, k), np.int32)
    for i in range(n):
        out[i, order[i]] = label[i]
    return sums[-1], out


def _block(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = np.zeros((len(pdf), k), np.int64)
        parts[:, 0] = pdf["bytes"].to_numpy()
        _, label = difference(parts)
        return pd.DataFrame({"digest": pdf["digest"], "node": pdf["node"], "bin": label[:, 0], "bytes": pdf["bytes"]})

    return run


def _join(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        _, label = difference(np.array([list(x) for x in pdf["sums"]], np.int64).reshape(-1, k))
        return pd.DataFrame({"node": pdf["node"].repeat(k), "bin": np.tile(np.arange(k), len(pdf)), "parent": pdf["parent"].repeat(k), "parent_bin": label.ravel()})

    return run


def assign_shards(docs: DataFrame, shards: int, block_groups: int = BLOCK_GROUPS, fan_in: int = FAN_IN, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Put every row of docs (doc_id, text) into one of `shards` shards of nearly equal bytes.

    Rows with equal texts form a group that stays together; a null text counts as empty. A row
    weighs the UTF-8 bytes of its text plus 16. Blocks of groups, dealt by digest, are differenced
    in parallel; their partial partitions, of `shards` sums each, are then differenced in turn, over
    as many levels as it takes. Rows with null or repeated doc_id are rows like any other. An empty
    table gives an empty result; other columns are ignored. No task holds more than a block.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null for this law).
    """
    text = text_or_empty()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )
    rows = save(rows, "rows")
    n = rows.count()
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    blocks = blocks_for(n, block_groups)
    groups = groups.withColumn("node", salt(F.col("digest"), blocks).cast("long"))
    placed = save(
        groups.groupBy("node").applyInPandas(_block(shards), "digest binary, node long, bin int, bytes long"), "placed"
    )
    label = _levels(placed, blocks, shards, fan_in)
    home = placed.join(F.broadcast(label) if blocks * shards <= 1_000_000 else label, ["node", "bin"]).select("digest", "shard")
    parts = blocks_for(n, slot_rows)
    rows = rows.join(home, "digest").withColumn("part", salt(F.struct("doc_id", "digest"), parts))
    rows = save(rows, "sharded")
    return _slots(rows, parts, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _levels(placed: DataFrame, nodes: int, k: int, fan_in: int) -> DataFrame:
    """(node, bin) of the first level to the final shard."""
    sums = placed.groupBy("node", "bin").agg(F.sum("bytes").alias("bytes"))
    label = None
    while True:
        vector = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.element_at("by_bin", i), F.lit(0).cast("long")))
        level = (
            sums.groupBy("node")
            .agg(F.map_from_entries(F.collect_list(F.struct("bin", "bytes"))).alias("by_bin"))  # at most k entries
            .select("node", vector.alias("sums"), F.floor(F.col("node") / fan_in).alias("parent"))
        )
        step = save(level.groupBy("parent").applyInPandas(_join(k), "node long, bin int, parent long, parent_bin int"), "level")
        here = step.select("node", "bin", F.col("parent").alias("p"), F.col("parent_bin").alias("pb"))
        if label is None:
            label = here
        else:
            on = (label.p == here.node) & (label.pb == here.bin)
            label = label.join(here.withColumnsRenamed({"p": "np", "pb": "npb"}), on).select(label.node, label.bin, F.col("np").alias("p"), F.col("npb").alias("pb"))
            label = save(label, "label")
        nodes = blocks_for(nodes, fan_in)
        if nodes == 1:
            return label.select("node", "bin", F.col("pb").alias("shard"))
        sums = sums.join(here, ["node", "bin"]).groupBy(F.col("p").alias("node"), F.col("pb").alias("bin")).agg(F.sum("bytes").alias("bytes"))


def _slots(rows: DataFrame, parts: int, shards: int) -> DataFrame:
    """Gapless places within each shard: an offset for each part of a shard plus the place in that part."""
    counts = rows.groupBy("shard", "part").count()
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("shard", "part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start"))
    start = F.broadcast(start) if parts * shards <= 1_000_000 else start
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "digest"))
    return rows.withColumn("place", place).join(start, ["shard", "part"]).withColumn("slot", F.col("start") + F.col("place") - 1)
