"""Word hashes tell apart what polynomials modulo 2 ** 64 don't."""

import re

import numpy as np

from tests.llm.common import cases, frame
from tests.llm.test_substring import by_force, got
from threadlake.llm import jaccard, words

COMMON = "one two three four five six seven eight nine ten eleven twelve"


def thue_morse(letters, bits=10):
    word = letters[0]
    for _ in range(bits):
        word += word.translate(str.maketrans("".join(letters), "".join(reversed(letters))))
    return word


def rows(*texts):
    return [(i, t, *[None] * 11) for i, t in enumerate(texts, 1)]


def test_words_are_runs_between_blanks():
    texts = [r[1] or "" for r in cases()] + [" \x1c\x85 a\x0bb\x00\xa0c  ", "\t\n\r"]
    for text, h in zip(texts, words.word_hashes(texts), strict=True):
        own = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert [x.tobytes() for x in h] == [words._digest(w) for w in own]
    assert list(words.word_hashes([])) == []


def test_mirrored_words_are_no_repeats(spark):
    a, b = "ab", "ba"
    for bits in (10, 12):
        docs = rows(f"{thue_morse(a, bits)} {COMMON}", f"{thue_morse(b, bits)} {COMMON}")
        assert got(frame(spark, docs)) == by_force([r[:2] for r in docs])
        assert all(r[2] == 0 for r in got(frame(spark, docs)))


def test_mirrored_orders_of_words_are_no_repeats(spark):
    line = thue_morse(("x", "y"), 5)
    docs = rows(" ".join(line), " ".join(line.translate(str.maketrans("xy", "yx"))))
    for window in (16, 32, 13):
        assert got(frame(spark, docs), window) == by_force([r[:2] for r in docs], window)


def test_mirrored_words_are_no_links(spark):
    a, b = ([thue_morse(pair) for pair in pairs] for pairs in (("ab", "cd", "ef", "gh", "ij", "kl"), ("ba", "dc", "fe", "hg", "ji", "lk")))
    out = jaccard.near_duplicates(frame(spark, rows(" ".join(a), " ".join(b)))).collect()
    assert {r["class_id"] for r in out} == {1, 2} and not any(r["n_links"] for r in out)


def test_the_pipeline_keeps_mirrored_documents(spark):
    import corpus_pipeline

    a, b = (" ".join(thue_morse(p) for p in pairs) for pairs in (("ab", "cd", "ef", "gh", "ij"), ("ba", "dc", "fe", "hg", "ji")))
    docs = frame(spark, rows(a, b, "a third text of quite other words"))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()) == [1, 2, 3]


def test_second_lane_decides():
    a = np.array([5, 5, 7, 5, 7], np.uint64)
    b = np.array([1, 2, 1, 1, 1], np.uint64)
    assert words.numbered(a, b).tolist() == [0, 1, 2, 0, 2]
