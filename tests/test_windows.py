"""Medoids for all numbers of clusters at once, and scores of windows against places known for all of them."""

import time

import numpy as np
import pytest

from pathloom.operators import graph
from pathloom.operators import places as L
from pathloom.operators.graph import distance_matrix

STEP = float(np.degrees(1 / graph.EARTH_M))


def plain(d, k, w):
    """Greedy build and best swaps, every candidate priced anew."""
    n, price = len(d), lambda ms: (w * d[:, ms].min(1)).sum()
    m = []
    for _ in range(min(k, n)):
        m.append(min((x for x in range(n) if x not in m), key=lambda x: price([*m, x])))
    while True:
        swaps = [(price([*m[:i], h, *m[i + 1 :]]), i, h) for i in range(len(m)) for h in range(n) if h not in m]
        if not swaps or min(swaps)[0] >= price(m) - 1e-6:
            return np.array(sorted(m))[d[:, sorted(m)].argmin(1)]
        _, i, h = min(swaps)
        m[i] = h


@pytest.mark.parametrize("seed", range(6))
def test_all_numbers_of_medoids_are_as_one_by_one(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(6, 40))
    d, w = distance_matrix(-89 + rng.normal(0, 0.05, n), 43 + rng.normal(0, 0.05, n)), rng.integers(1, 9, n).astype(float)
    got = list(graph.pams(d, 2, 9, w))
    assert len(got) == 8
    for k, label in enumerate(got, 2):
        assert label.tolist() == plain(d, k, w).tolist() == graph.pam(d, k, w).tolist()


def test_medoids_of_many_positions():
    rng = np.random.default_rng(1)
    lon, lat = -89 + rng.normal(0, 0.05, 1300), 43 + rng.normal(0, 0.05, 1300)
    t = time.time()
    label, k = L._labels(lon, lat, 2, 20, False)
    assert 2 <= k <= 20 and len(label) == 1300 and time.time() - t < 12


def test_windows_against_places_known_for_all(spark):
    places = spark.createDataFrame([(1, w, c, 43.0 + m * STEP, -89.0) for w, c, m in [(1, 1, 0), (2, 1, 0), (2, 2, 900), (3, 1, 400)]] + [(2, 1, 1, 43.0, -89.0)], "subid int, window_days int, cluster_id int, lat double, lon double")
    known = spark.createDataFrame([(1, 1, 43.0 + 50 * STEP, -89.0), (1, 2, 43.0 + 850 * STEP, -89.0), (3, 1, 43.0, -89.0)], "subid int, location_id int, lat double, lon double")
    by = ["subid", "window_days"]
    got = sorted(tuple(r) for r in L.capture(places, known, by=by).select(*by, "n_places", "n_truth", "precision", "recall").collect())
    assert got == [(1, 1, 1, 2, 1.0, 0.5), (1, 2, 2, 2, 1.0, 1.0), (1, 3, 1, 2, 0.0, 0.0)]
    per_window = known.join(places.select(*by).distinct(), "subid")
    assert sorted(tuple(r) for r in L.capture(places, per_window, by=by).select(*by, "n_places", "n_truth", "precision", "recall").collect()) == got
