import struct

import numpy as np
import pytest

from tests.llm.common import cases, frame
from threadlake.llm.sentencepiece import BPE, UNIGRAM, Transducer, encode_documents

tokenizers = pytest.importorskip("public_tokenizers")


def _model() -> bytes:
    with open(tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += _varint(number << 3 | 2) + _varint(len(value)) + value
        elif isinstance(value, float):
            out += _varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += _varint(number << 3) + _varint(value)
    return out


def tiny(kind):
    """A hand-made model without byte fallback."""
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.5, 1), ("b", -2.6, 1), ("ab", -4.0, 1), ("▁ab", -4.5, 1), ("ba", -3.5, 1), ("aba", -6.0, 1)]
    parts = [(1, _message((1, t.encode()), (2, s), (3, k))) for t, s, k in pieces]
    return _message(*parts, (2, _message((3, kind))), (3, _message((3, 1), (4, 0))))


def best_by_force(t, text):
    """The cheapest of all segmentations of a unigram model."""
    if not text:
        return 0.0
    return min((-t.scores[t.ids[text[:i]]] if text[:i] in t.ids else -t.worst) + best_by_force(t, text[i:]) for i in range(1, len(text) + 1) if text[:i] in t.ids or i == 1)


def test_unigram_path_is_the_cheapest():
    t = Transducer(tiny(UNIGRAM))
    for text in ["abab", "ba", "bbaab", "xab", "aab b"]:
        unit = t.normalise(text)
        cost = sum(-t.scores[t.ids[p]] if p in t.ids else -t.worst for p in t.path(unit))
        assert "".join(t.path(unit)) == unit and abs(cost - best_by_force(t, unit)) < 1e-5


def merge_by_force(t, text):
    parts = list(text)
    while True:
        found = [(t.scores[t.ids[a + b]], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in t.ids]
        if not found:
            return parts
        i = -max(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_bpe_path_is_what_merging_gives():
    t = Transducer(tiny(BPE))
    rng = np.random.default_rng(0)
    for _ in range(300):
        unit = t.normalise("".join(rng.choice(list("ab x"), rng.integers(1, 12))))
        assert t.path(unit) == merge_by_force(t, unit)


def test_library_agrees():
    library = pytest.importorskip("sentencepiece")
    t = Transducer(_model())
    sp = library.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    for _, text, *_ in cases():
        ids = t.encode(text or "")
        assert ids.tolist() == sp.encode(text or "")
        assert t.decode(ids) == sp.decode(ids.tolist())


def test_query_round_trips(spark):
    got = encode_documents(frame(spark), _model()).collect()
    assert len(got) == len(cases())
    assert sum(not r["round_trip"] for r in got) == 1  # a literal space sign becomes a space
    assert all(r["n_ids"] == len(r["ids"]) for r in got)
    assert encode_documents(frame(spark, []), _model()).count() == 0
