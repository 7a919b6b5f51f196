"""Containers hold every item once, nothing too much, and little room stays free."""

import os
from itertools import product

import numpy as np
import pytest

from pathloom.llm.packing import TOKENIZER_FILE, _closest, fill_report, pack, plan_patterns, token_counts


def test_closest_is_the_closest():
    rng = np.random.default_rng(2)
    for _ in range(200):
        pool = dict(sorted(((int(k), int(rng.integers(1, 4))) for k in rng.choice(np.arange(1, 15), 4, replace=False)), reverse=True))
        room = int(rng.integers(0, 30))
        best = max(t for n in product(*(range(v + 1) for v in pool.values())) if (t := sum(a * b for a, b in zip(n, pool, strict=True))) <= room)
        pick = _closest(pool, room)
        assert sum(k * v for k, v in pick.items()) == best and all(v <= pool[k] for k, v in pick.items())


def test_patterns_use_up_all_lengths_and_all_are_offered():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2049, 5000)
    counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
    patterns = plan_patterns(counts, 2048)
    used = {}
    for use, times in patterns:
        assert sum(k * v for k, v in use.items()) <= 2048
        for k, v in use.items():
            used[k] = used.get(k, 0) + v * times
    assert used == counts
    assert sum(t for _, t in patterns) <= 1.02 * lengths.sum() / 2048 + 1


@pytest.mark.parametrize("partitions", [1, 7])
def test_every_piece_has_one_place(spark, partitions):
    rng = np.random.default_rng(4)
    sizes = [*rng.integers(1, 100, 400).tolist(), 0, None, -3, 64, 64, 65, 200, *([7] * 300)]
    items = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id long, n long, length string").repartition(partitions)
    got = pack(items, "doc_id", "n", 64).toPandas()
    assert got.groupby("container_id")["length"].sum().max() <= 64
    assert sorted(got["container_id"].unique()) == list(range(got["container_id"].nunique()))
    whole = got.groupby("doc_id")["length"].sum()
    assert whole.to_dict() == {i: s for i, s in enumerate(sizes) if s and s > 0}
    assert (got.groupby("doc_id").size()[[i for i, s in enumerate(sizes) if s and 0 < s <= 64]] == 1).all()
    report = fill_report(pack(items, "doc_id", "n", 64), 64).first()
    assert report["containers"] == got["container_id"].nunique() and report["containers"] <= report["fewest"] * 1.02 + 1


def test_empty_input(spark):
    items = spark.createDataFrame([], "doc_id long, n long")
    assert pack(items, "doc_id", "n", 64).count() == 0
    assert fill_report(pack(items, "doc_id", "n", 64), 64).first()["containers"] == 0


@pytest.mark.skipif(not os.path.exists(TOKENIZER_FILE), reason="needs the vocabulary file")
def test_tokens_are_counted(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "a" * 200_000)], "doc_id long, text string")
    n = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, "doc_id").collect()}
    assert n[1] == 2 and n[2] == n[3] == 0 and 0 < n[4] <= 200_000
