"""Shared spans against all windows, also where many records share one."""

import random
from collections import defaultdict

import numpy as np
import pytest

from pathloom.llm import spans
from pathloom.llm.spans import difference_cover, shared_pairs, shared_report

SPAN = 40


def corpus(seed: int, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeß \n") for _ in range(rng.randrange(5, 30)))
    stock = [word() + word() for _ in range(3)]  # too short to count
    long = ["".join(word() for _ in range(6)) for _ in range(3)]  # span enough, in many records
    texts = []
    for _ in range(n):
        parts = [word() for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.7:
            parts.insert(rng.randrange(len(parts)), rng.choice(stock)[:38])
        if rng.random() < 0.5:
            cut = rng.choice(long)
            s = rng.randrange(0, max(1, len(cut) - SPAN))
            parts.insert(rng.randrange(len(parts)), cut[s : s + rng.choice([SPAN - 1, SPAN, SPAN + 25])])
        texts.append("".join(parts))
    texts[5:8] = [texts[4]] * 3
    return [*((i, t, 1) for i, t in enumerate(texts)), (n, None, 1), (n + 1, "", 1), (n + 2, "short", 1), (n + 3, "short", 1)]


def brute(rows):
    at = defaultdict(set)
    for k, t, _ in rows:
        for i in range(len(t or "") - SPAN + 1):
            at[t[i : i + SPAN]].add((k, i))
    pairs, cover = set(), defaultdict(set)
    for group in at.values():
        keys = {k for k, _ in group}
        if len(keys) > 1:
            pairs |= {(a, b) for a in keys for b in keys if a < b}
            for k, i in group:
                cover[k] |= set(range(i, i + SPAN))
    return pairs, {k: len(v) for k, v in cover.items()}


@pytest.mark.parametrize("crowd", [2, 24])
@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_shares(spark, monkeypatch, crowd, seed):
    monkeypatch.setattr(spans, "CROWD", crowd)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, h int").repartition(3)
    pairs, cover = brute(rows)
    assert {(r["doc_id_a"], r["doc_id_b"]) for r in shared_pairs(docs, span=SPAN, period=13).collect()} == pairs and len(pairs) > 20
    report = {r["doc_id"]: r for r in shared_report(docs, span=SPAN, period=13).collect()}
    assert set(report) == {k for k, t, _ in rows if t is not None}
    for k, r in report.items():
        assert r["shared_chars"] == cover.get(k, 0)
        assert r["n_partners"] == sum(k in p for p in pairs)
        assert r["class_id"] == min(j for j, t, _ in rows if t == rows[k][1])


def test_a_span_in_every_record_over_several_batches(spark, monkeypatch):
    monkeypatch.setattr(spans, "CROWD", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        stock = "".join(random.Random(1).choice("abcdefgh") for _ in range(39))
        docs = spark.createDataFrame([(i, chr(0x4E00 + i) + stock + chr(0x5E00 + i), 1) for i in range(40)] + [(100, "x" + stock + "tail", 1), (101, "x" + stock + "other", 1)], "doc_id long, text string, n int")
        assert {tuple(r) for r in shared_pairs(docs, span=SPAN, period=13).collect()} == {(100, 101)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_records(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert shared_pairs(docs).count() == 0 and shared_report(docs).count() == 0


@pytest.mark.parametrize("period", [7, 13, 31, 57, 133, 50])
def test_covers_have_all_differences(period):
    c = np.array(difference_cover(period))
    assert len({(int(a) - int(b)) % period for a in c for b in c}) == period
