"""Curve packing: every id in one piece, full or power-of-two sequences, neighbours that are alike."""

import itertools
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from threadlake.llm import curve
from threadlake.llm.queries import tokenizer_file

from .common import frame, prose


@pytest.fixture(scope="module")
def tokenizer():
    with open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.mark.parametrize(("length", "range_ids"), [(1024, 4_000_000), (64, 3000), (100, 20_000)])
def test_pieces_are_whole_and_nothing_is_padded(spark, tokenizer, length, range_ids):
    docs = frame(spark)
    got = curve.pack(docs, tokenizer, length, range_ids=range_ids).collect()
    use = Tokenizer.from_str(tokenizer)
    want: dict = {}
    for r in docs.collect():
        ids = np.array([*use.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(r.doc_id, []).append(ids)
    for doc, texts in want.items():
        own = sorted((r for r in got if r.doc_id == doc), key=lambda r: (r.start, r.length))
        assert sum(r.length for r in own) == sum(map(len, texts))
        assert {r.doc_tokens for r in own} == set(map(len, texts))
        if len(texts) == 1:
            at = 0
            for r in own:
                assert r.start == at and r.ids_crc32 == zlib.crc32(texts[0][at : at + r.length].tobytes())
                at += r.length
    by = itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id)
    sizes = []
    for _, pieces in by:
        at = 0
        for r in pieces:
            assert r.offset == at and r.length > 0
            at += r.length
        sizes.append(at)
    assert all(n == length or n < length and n & (n - 1) == 0 for n in sizes)
    assert sum(n != length for n in sizes) <= 12 * max(1, -(-sum(sizes) // range_ids))


def test_keys_walk_through_neighbouring_cells():
    for n, bits in ((2, 4), (3, 3), (4, 2), (4, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        keys = curve.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_documents_of_a_kind_are_packed_together(spark, tokenizer):
    import random

    rng = random.Random(4)
    kinds = [[prose(rng, 1) for _ in range(40)] for _ in range(6)]
    rows = [(i, " ".join(rng.choices(kinds[i % 6], k=60)), *["x"] * 11) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = curve.pack(docs, tokenizer, 1024).orderBy("sequence_id", "offset").collect()
    line = [r.doc_id % 6 for r in got if r.start == 0]
    same = sum(a == b for a, b in itertools.pairwise(line)) / len(line)
    assert len(line) == 300 and same > 0.5  # by chance: a sixth


def test_copies_of_one_text_fill_many_ranges(spark, tokenizer):
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat('one text of many copies ', 20) as text")
    got = curve.pack(docs, tokenizer, 256, range_ids=10_000)
    tasks = got.selectExpr("sequence_id >> 40 as task").distinct().count()
    total = got.agg({"length": "sum"}).first()[0]
    assert tasks > 0.6 * total / 10_000


def test_empty_table(spark, tokenizer):
    assert curve.pack(frame(spark, []), tokenizer).collect() == []
