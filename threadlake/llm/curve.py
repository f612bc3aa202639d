"""Sequences of neighbouring documents: a Hilbert curve through hashed document vectors orders what is packed."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import encoder
from .shared import blocks_for, save, text_or_empty

#: Buckets that token ids are hashed to, dimensions of the projection, bits of each and their range in standard deviations.
BUCKETS, DIMENSIONS, BITS, SPREAD = 1024, 4, 15, 4.0
#: Ids that one range of the curve holds, about.
RANGE_IDS = 4_000_000


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(1891).standard_normal((BUCKETS, DIMENSIONS))


def document_vector(ids: np.ndarray) -> np.ndarray:
    """A unit vector of a text's ids, hashed to signed buckets whose counts are damped; zero for no ids."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    v = np.bincount((h >> np.uint64(54)).astype(np.int64), 1.0 - 2.0 * ((h >> np.uint64(20)) & np.uint64(1)), BUCKETS)
    v = np.sign(v) * np.sqrt(np.abs(v))
    size = np.sqrt((v * v).sum())
    return v / size if size else v


def _encoded(tokenizer_json: str, end_id: int, wide: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each text's ids, the end id after them, and its projected vector."""
        use = encoder(tokenizer_json)
        for pdf in batches:
            held, n, z = [], [], []
            for text in pdf["text"]:
                ids = np.frombuffer(use.encode(text), "<u4")
                z.append(document_vector(ids) @ _projection())
                n.append(len(ids) + 1)
                held.append(np.append(ids, np.uint32(end_id)).astype("<u4" if wide else "<u2").tobytes())
            z = np.array(z).reshape(-1, DIMENSIONS)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "ids": held, "doc_tokens": n} | {f"z{d}": z[:, d] for d in range(DIMENSIONS)})

    return run


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of cells (rows, dimensions), each coordinate below 2 ** bits.

    From the largest squares to the smallest, each step takes one bit of every coordinate, turns the cell so
    that the sub-square it lies in has the curve's first orientation, and notes which sub-square that was
    (Skilling's transform); the Gray code of those notes is the place.
    """
    x = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        q, below = 1 << bit, (1 << bit) - 1
        for d in range(n):
            is_set = (x[d] & q) != 0
            swap = np.where(is_set, 0, (x[0] ^ x[d]) & below)
            x[0] = np.where(is_set, x[0] ^ below, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
    for d in range(1, n):
        x[d] = x[d] ^ x[d - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn = np.where(x[n - 1] & (1 << bit), turn ^ ((1 << bit) - 1), turn)
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(n):
            key = key << 1 | ((x[d] ^ turn) >> bit & 1)
    return key


def _key_column(rows: DataFrame) -> Column:
    """Hilbert keys of rows' projections, brought to the mean and spread of all rows."""
    names = [f"z{d}" for d in range(DIMENSIONS)]
    stats = rows.agg(*[F.avg(c).alias(f"m{c}") for c in names], *[F.stddev_pop(c).alias(f"s{c}") for c in names]).first()
    mean = np.array([stats[f"m{c}"] or 0.0 for c in names])
    spread = np.array([stats[f"s{c}"] or 1.0 for c in names])

    @F.pandas_udf("long")
    def key(z0: pd.Series, z1: pd.Series, z2: pd.Series, z3: pd.Series) -> pd.Series:
        z = (np.column_stack([z0, z1, z2, z3]) - mean) / spread
        cells = np.clip((z + SPREAD) / (2 * SPREAD), 0, 1) * ((1 << BITS) - 1)
        return pd.Series(hilbert_keys(cells.astype(np.int64), BITS))

    return key(*names)


def _cut(length: int, wide: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pieces of the documents of one range in turn: full sequences, and at the end shorter ones of a power of two.

        What is held between documents is the open sequence alone.
        """
        base, number, used = TaskContext.get().partitionId() << 40, 0, 0
        open_: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of the sequence that is being filled

        def close(pieces: list[tuple], size: int) -> Iterator[tuple]:
            nonlocal number
            offset = 0
            for doc, start, ids, tokens in pieces:
                yield doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, base + number, offset
                offset += len(ids)
            assert offset == size
            number += 1

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            return out.astype({"doc_id": "Int64"} | {c: "int64" for c in out.columns[1:]})

        for pdf in batches:
            rows: list[tuple] = []
            for doc, raw in zip(pdf["doc_id"], pdf["ids"], strict=True):
                ids = np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4")
                at = 0
                while at < len(ids):
                    take = min(length - used, len(ids) - at)
                    open_.append((None if pd.isna(doc) else int(doc), at, ids[at : at + take], len(ids)))
                    at, used = at + take, used + take
                    if used == length:
                        rows += close(open_, length)
                        open_, used = [], 0
            yield frame(rows)
        rows = []
        while used:
            size, part, left = 1 << used.bit_length() - 1, [], []
            room = size
            for doc, start, ids, tokens in open_:
                head, tail = ids[:room], ids[room:]
                room -= len(head)
                if len(head):
                    part.append((doc, start, head, tokens))
                if len(tail):
                    left.append((doc, start + len(head), tail, tokens))
            rows += close(part, size)
            open_, used = left, used - size
        yield frame(rows)

    return run


def pack(docs: DataFrame, tokenizer_json: str, length: int = 1024, end_id: int = 0, range_ids: int = RANGE_IDS) -> DataFrame:
    """Pack all rows of docs (doc_id, text) into sequences of at most `length` ids, neighbours along a curve together.

    A row's ids, a null text's being none, are followed by end_id. Hashed vectors of the ids are projected to
    four dimensions, brought to mean 0 and spread 1 over all rows, and give a place on a Hilbert curve; rows
    are sorted by ranges of that place, equal places by a hash of the row, so that copies of one text fill as
    many ranges as they need. Each range's ids are cut into sequences of exactly `length`, and what is left at
    its end into such of a power of two: nothing is padded where lengths of a power of two need none.

    Ids are encoded once and written (16 bits each where the vocabulary allows), then moved once. Rows with
    null or repeated doc_id are rows like any other. An empty table gives an empty result; other columns are
    ignored; a text of any length is encoded whole, by one task.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    wide = max(encoder(tokenizer_json).tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    z = ", ".join(f"z{d} double" for d in range(DIMENSIONS))
    rows = save(texts.mapInPandas(_encoded(tokenizer_json, end_id, wide), f"doc_id long, ids binary, doc_tokens long, {z}"), "ids", compression="zstd")
    total = rows.agg(F.sum("doc_tokens")).first()[0] or 0
    keyed = rows.select("doc_id", "ids", _key_column(rows).alias("place"), F.xxhash64("doc_id", "doc_tokens", *[f"z{d}" for d in range(DIMENSIONS)]).alias("tie"))
    dealt = keyed.repartitionByRange(blocks_for(total, range_ids), "place", "tie").sortWithinPartitions("place", "tie")
    pieces = dealt.select("doc_id", "ids").mapInPandas(
        _cut(length, wide), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return save(pieces, "pieces")
