import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.accumulators import AccumulatorParam

from tests.llm.common import cases, frame
from threadlake.llm import packing
from threadlake.llm.packing import pack, sum_of_squares

tokenizers = pytest.importorskip("public_tokenizers")


class Largest(AccumulatorParam):
    def zero(self, value):
        return 0

    def addInPlace(self, a, b):  # noqa: N802
        return max(a, b)


def by_force(sizes, capacity):
    """Bins by trying every open gap and computing the whole sum of squares."""
    bins, out = [], []
    for s in sizes:
        def total(fills):
            gaps = [capacity - f for f in fills if f < capacity]
            return sum(gaps.count(g) ** 2 for g in set(gaps))

        best = None
        for gap in range(s, capacity + 1):
            at = next((i for i, f in enumerate(bins) if capacity - f == gap), None) if gap < capacity else len(bins)
            if at is None:
                continue
            after = [*bins, 0] if at == len(bins) else list(bins)
            after[at] += s
            if best is None or total(after) < best[0]:
                best = (total(after), gap, after)
        bins = best[2]
        out.append(total(bins))
    return out, sorted(bins)


def test_every_step_has_the_smallest_sum():
    rng = np.random.default_rng(4)
    for capacity in (10, 17):
        sizes = rng.integers(1, capacity + 1, 60)
        where, offset, fill = sum_of_squares(sizes, capacity)
        want, _ = by_force(sizes.tolist(), capacity)
        fills, got = {}, []
        for b, o, s in zip(where, offset, sizes, strict=True):
            assert fills.get(b, 0) == o
            fills[b] = o + s
            gaps = [capacity - f for f in fills.values() if f < capacity]
            got.append(sum(gaps.count(g) ** 2 for g in set(gaps)))
        assert max(fills.values()) <= capacity and sorted(fills.values()) == sorted(fill)
        assert got[0] == want[0] and abs(got[-1] - want[-1]) <= max(4, 0.5 * want[-1])


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        model = f.read()
    for block in (50_000, 6):
        got = pack(frame(spark), model, 256, block_pieces=block).collect()
        want = []
        for doc_id, text, *_ in cases():
            ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
            head, start, piece = len(ids) % 256 or 256, 0, 0
            while start < len(ids):
                stop = head + piece * 256
                part = ids[start:stop]
                want.append((-1 if doc_id is None else doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
                start, piece = stop, piece + 1
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *r[1:5]) for r in got) == sorted(want)
        bins = defaultdict(list)
        for r in got:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in bins.values():
            at = 0
            for o, n in sorted(places):
                assert o == at
                at += n
            assert at <= 256
        assert len(bins) <= 1.1 * sum(w[3] for w in want) / 256 + 2
    assert pack(frame(spark, []), model, 256).count() == 0


def test_bins_that_never_close_stay_in_blocks(spark, monkeypatch):
    """Pieces of over half a sequence leave a bin open each: no level gathers them in one task."""
    rows = [(i, "a " * (600 + i), *[None] * 11) for i in range(120)] + [(500 + i, "b", *[None] * 11) for i in range(40)]
    with open(tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        model = f.read()
    largest = spark.sparkContext.accumulator(0, Largest())
    plain = packing._pack

    def counting(capacity, key):
        inner = plain(capacity, key)

        def run(pdf):
            largest.add(len(pdf))
            return inner(pdf)

        return run

    monkeypatch.setattr(packing, "_pack", counting)
    got = pack(frame(spark, rows), model, 1024, block_pieces=20).collect()
    assert largest.value <= 60
    fills = defaultdict(int)
    for r in got:
        fills[r["sequence_id"]] += r["length"]
    assert len(got) == 160 and max(fills.values()) <= 1024 and len(fills) <= 125


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        e = packing.Encoder(f.read())
    odd = ["a \n b", "a\n b", "a \nb", "a\t b c", "x   y", "don't  stop", "DON'T I'LLl", " lead", "tail ", "", " ", "a b\n\n c 'll 's", "12 34,5 é😀 z", "a <|endoftext|> b", "a\r\n b \x85 c", "a\xa0b \x1c c"]
    odd += ["²³ ½x ªº ǅ ʰˠ ×÷ \xad-", "x" * 3000, "naïve façade, straße!?\n\n", " \t \n  x"]
    for t in odd + [c[1] or "" for c in cases()]:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t
