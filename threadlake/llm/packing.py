"""Sequences of bounded length by sum-of-squares packing."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks_for, salt, save, text_or_empty

#: Pieces that one packing task places.
BLOCK_PIECES = 50_000
#: Levels at which open bins are packed again, and the share of them that has to close for another one.
LEVELS, HELP = 32, 0.05
#: Characters whose classes no Unicode version changes; a text with any other goes to the tokenizer itself.
_UNUSUAL = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\u02ff]")


class Encoder:
    """Ids of whole texts by a tokenizer file, which must be byte-level BPE.

    The file's vocabulary gives the merge ranks too, so texts of common characters without a special
    token's string are encoded by ranks, which is several times faster and gives the same ids.
    """

    def __init__(self, tokenizer_json: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        self.special = [t["content"] for t in spec["added_tokens"]]
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in visible]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        assert set(byte_of) == set(pre_tokenizers.ByteLevel.alphabet())
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        ranks = {bytes(byte_of[c] for c in k): v for k, v in vocab.items()}
        # The byte-level pre-tokenizer's own pattern, which its file does not spell out; any other goes without.
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        plain = plain and not spec.get("normalizer") and not spec["model"].get("ignore_merges") and not spec["model"].get("dropout")
        self.by_rank = Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if plain else None

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.by_rank is None or _UNUSUAL.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.by_rank.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=2)
def encoder(tokenizer_json: str) -> Encoder:
    return Encoder(tokenizer_json)


def _pieces(tokenizer_json: str, length: int, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = encoder(tokenizer_json)
        end = np.array([end_id], "<u4").tobytes()
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = use.encode(text) + end
                n = len(ids) // 4
                head = n % length or length  # only the first piece may be shorter
                start = 0
                for piece in range(-(-n // length)):
                    stop = head + piece * length
                    out.append((doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start = stop
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64"})

    return run


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place sizes (1 to capacity) in turn where the squared counts of open bins per gap become smallest.

    Putting a piece of size s in a bin of gap g takes one from count g and adds one to count g - s; a new
    bin only adds one at capacity - s. Gap 0 is not counted. At equal sums the smaller gap wins.
    Returns each piece's bin, its offset there, and the fill of each bin.
    """
    count = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        # Change of the sum, halved, less constants: -(count[g] - 1) + count[g - s] for g > s; a gap of exactly s closes a bin.
        cost = count[: capacity - s + 1] - count[s:] + 1
        cost[0] = -count[s]  # the result's gap 0 is free: (n - 1)^2 - n^2 = 1 - 2n
        twice = 2 * cost
        twice[0] += 1
        twice[count[s:] == 0] = np.iinfo(np.int64).max
        new = 2 * count[capacity - s] + 1 if s < capacity else 0
        g = int(twice.argmin()) + s
        if twice[g - s] <= new:
            b = bins[g].pop()
            count[g] -= 1
        else:
            g, b = capacity, len(fill)
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += s
        if g - s:
            bins[g - s].append(b)
            count[g - s] += 1
    return where, offset, np.array(fill, np.int64)


def _pack(capacity: int, key: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", *key], ascending=[False, *[True] * len(key)], ignore_index=True)
        where, offset, fill = sum_of_squares(pdf["size"].to_numpy(), capacity)
        return pdf.assign(bin=where, offset=offset, fill=fill[where] if len(pdf) else offset)

    return run


def pieces_of(docs: DataFrame, tokenizer_json: str, length: int, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every whole text of docs and the end id after it."""
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    return texts.mapInPandas(_pieces(tokenizer_json, length, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_json: str, length: int = 2048, end_id: int = 0, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Pack all rows of docs (doc_id, text) into few sequences of at most `length` ids.

    A row's ids, a null text's being none, are followed by end_id; only longer ones are cut, into pieces of
    `length`, the first of which may be shorter. A full piece is a sequence. The others are dealt to blocks
    of about block_pieces by their row, and each block is packed by sums of squares, largest first. The bins
    that stayed open are then dealt anew to such blocks and packed as wholes, level by level, until one block
    holds them all or a level closes fewer than HELP of them; no task ever holds more than a block. Rows with
    null or repeated doc_id are rows like any other. An empty table gives an empty result; other columns are
    ignored; a text of any length is encoded whole, by one task.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    # Rows that share everything, doc_id and crc included, are still pieces of their own: they get numbers.
    rows = save(pieces_of(docs, tokenizer_json, length, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = rows.where(F.col("length") == length).withColumn("sequence_id", F.col("row") * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    part = rows.where(F.col("length") < length)
    items, n = part.select("row", F.col("length").alias("size")), part.count()
    open_, done = None, []
    for level in range(LEVELS):
        blocks = blocks_for(n, block_pieces)
        dealt = items.withColumn("block", salt(F.struct(F.lit(level), "row"), blocks).cast("long"))
        packed = dealt.groupBy("block").applyInPandas(_pack(length, ["row"]), "block long, row long, size long, bin long, offset long, fill long")
        bin_id = (F.col("bin") * blocks + F.col("block")) * LEVELS + level
        packed = save(packed.select("row", bin_id.alias("bin"), "offset", "fill"), "packed")
        if open_ is None:
            placed = packed
        else:
            moved = packed.select(F.col("row").alias("bin"), F.col("bin").alias("to_"), F.col("offset").alias("more"), F.col("fill").alias("now"))
            placed = open_.join(moved, "bin").select("row", F.col("to_").alias("bin"), (F.col("offset") + F.col("more")).alias("offset"), F.col("now").alias("fill"))
            placed = save(placed, "placed")
        bins = save(packed.where(F.col("fill") < length).groupBy(F.col("bin").alias("row")).agg(F.max("fill").alias("size")), "open")
        left = bins.count()
        if blocks == 1 or left > (1 - HELP) * n:
            done.append(placed)
            break
        done.append(placed.where(F.col("fill") == length))
        open_, items, n = placed.where(F.col("fill") < length), bins, left
    else:
        done.append(open_)
    placed = reduce(DataFrame.unionByName, done)
    part = part.join(placed.select("row", (F.col("bin") * 2).alias("sequence_id"), "offset"), "row")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return full.select(*names).unionByName(part.select(*names))
