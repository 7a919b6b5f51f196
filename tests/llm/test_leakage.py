"""Leaked items against word-by-word brute force and in hand-made cases."""

import random

import numpy as np
import pytest

from pathloom.llm.leakage import Folding, align_all, leaked_items, plain

ITEM = [f"w{chr(97 + i)}" for i in range(26)] + ["wza"]  # 27 words, 14 are at least half
FILL = [f"other{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]


def text(*parts):
    return " ".join(w for p in parts for w in p)


def leaks(spark, docs, items):
    got = leaked_items(spark.createDataFrame(docs, "doc_id long, text string, held int"), spark.createDataFrame(items, "item_id long, text string, d string"))
    return {(r["doc_id"], r["item_id"]): (r["held"], r["words"]) for r in got.collect()}


def test_small_second_passages(spark):
    docs = {
        1: text(ITEM[:10], FILL, ITEM[20:24]),  # 10 and 4 words
        2: text(ITEM[:8], FILL, [*ITEM[18:20], "changed", *ITEM[21:25]]),  # 8 and 6 words, one shingle whole in the second
        3: text(ITEM[20:24], FILL, ITEM[:10]),  # not in the item's order
        4: text(ITEM[:13], FILL),  # a word short
        5: text(FILL, ITEM[7:21]),
    }
    got = leaks(spark, [(k, v, 0) for k, v in docs.items()], [(7, text(ITEM), "x")])
    assert got == {(1, 7): (14, 27), (2, 7): (14, 27), (5, 7): (14, 27)}


def test_forms_nulls_short_items_and_repeated_rows(spark):
    item = "Die Straße über Łódź führt zum CAFÉ am Fluß; dort wartete niemand lange auf uns."
    docs = [
        (1, "<p>x</p> die strasse über łódź führt zum café am fluss dort war-\n  tete niemand", 0),
        (2, None, 0),
        (3, "", 0),
        (4, "the cat sat", 0),
        (4, "the cat sat", 0),
        (None, "the cat sat", 0),
        (5, "die straße", 0),
    ]
    items = [(1, item, "x"), (2, "the cat", "x"), (2, "the cat", "x"), (3, None, "x"), (4, "", "x"), (5, "...", "x"), (None, "cat", "x")]
    assert leaks(spark, docs, items) == {(1, 1): (12, 15), (4, 2): (2, 2)}
    assert leaks(spark, [], items) == {} == leaks(spark, docs, [])


def test_a_hot_document_holds_many_items(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"v{rng.randrange(400)}" for _ in range(30)), "x") for i in range(150)]
    got = leaks(spark, [(1, " ".join(t for _, t, _ in items), 0), (2, items[5][1][:90], 0)], items)
    assert {i for d, i in got if d == 1} == set(range(150)) and all(v == (30, 30) for (d, _), v in got.items() if d == 1)


def slow(a, b):
    """Score of the best local alignment, cell by cell."""
    s = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            s[i + 1, j + 1] = max(0, s[i, j] + (2 if a[i] == b[j] else -1), s[i, j + 1] - 1, s[i + 1, j] - 1)
    return int(s.max())


def test_alignments_are_the_best():
    rng = np.random.default_rng(1)
    jobs = [(rng.integers(5, 11, rng.integers(0, 15)), rng.integers(5, 11, rng.integers(0, 30))) for _ in range(300)]
    for (a, b), (n, a0, a1, b0, b1) in zip(jobs, align_all(jobs), strict=True):
        top = slow(a, b)
        assert top == slow(a[a0:a1], b[b0:b1])
        assert n <= min(a1 - a0, b1 - b0) and 2 * n >= top


@pytest.mark.parametrize("texts", [["", "a"], ["", ""], ["one two", "", "x" * 3_000_000, "ß ½ ﬁ 한국 é a­b c_d"]])
def test_folding_counts_words(texts):
    h, off = Folding().words([plain(t) for t in texts])
    assert off[-1] == len(h) and len(off) == len(texts) + 1
    if len(texts) == 4:
        assert np.diff(off).tolist() == [2, 0, 1, 9]
