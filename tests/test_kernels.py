"""Kernels of clusters, matching, silhouettes and statistics against brute force and known values."""

import time
from itertools import combinations, permutations

import numpy as np
import pytest

from pathloom.functions.geo import np_haversine_m
from pathloom.functions.stats import incomplete_beta, t_two_sided
from pathloom.operators import graph
from pathloom.operators.graph import components, dbscan, distance_matrix, match_pairs, near_pairs, pam, silhouette


def spots(n, seed, wide=0.001):
    rng = np.random.default_rng(seed)
    lon, lat = -89 + rng.normal(0, wide, n), 43 + rng.normal(0, wide, n)
    lon[: n // 6], lat[: n // 6] = lon[n // 2 : n // 2 + n // 6], lat[n // 2 : n // 2 + n // 6]  # equal positions
    return lon, lat


@pytest.mark.parametrize("radius", [5.0, 40.0, 200.0])
def test_near_pairs(radius):
    lon, lat = spots(120, 1)
    i, j = near_pairs(lon, lat, radius)
    d = distance_matrix(lon, lat)
    assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a in range(120) for b in range(a + 1, 120) if d[a, b] <= radius]
    assert len(near_pairs(lon[:1], lat[:1], radius)[0]) == 0


def slow_dbscan(d, eps, min_pts):
    n = len(d)
    core = (d <= eps).sum(1) >= min_pts
    label, k = [0] * n, 0
    for s in range(n):
        if core[s] and not label[s]:
            k, todo = k + 1, [s]
            label[s] = k
            while todo:
                a = todo.pop()
                for b in range(n):
                    if core[b] and not label[b] and d[a, b] <= eps:
                        label[b] = k
                        todo.append(b)
    return [label[s] if core[s] else min((label[b] for b in range(n) if core[b] and d[s, b] <= eps), default=0) for s in range(n)]


@pytest.mark.parametrize("eps, min_pts", [(20.0, 1), (20.0, 2), (30.0, 3), (40.0, 5), (15.0, 200)])
@pytest.mark.parametrize("paired", [10**9, 0])
def test_dbscan(monkeypatch, eps, min_pts, paired):
    monkeypatch.setattr(graph, "PAIRED", paired)
    for seed in range(6):
        lon, lat = spots(90, seed)
        assert dbscan(lon, lat, eps, min_pts).tolist() == slow_dbscan(distance_matrix(lon, lat), eps, min_pts)


def test_a_crowded_place_needs_no_pairs():
    rng = np.random.default_rng(2)
    n = 150_000
    lon, lat = np.r_[rng.normal(-89, 1e-4, n), -89.1], np.r_[rng.normal(43, 1e-4, n), 43]
    t = time.time()
    label = dbscan(lon, lat, 50.0, 3)
    assert label[-1] == 0 and (label[:-1] == 1).mean() > 0.999 and time.time() - t < 30


def test_components():
    assert components(6, np.array([4, 1]), np.array([2, 5])).tolist() == [0, 1, 2, 3, 2, 1]
    assert components(0, np.zeros(0, int), np.zeros(0, int)).tolist() == []


@pytest.mark.parametrize("k", [1, 2, 3])
def test_medoids_cost_no_more_than_any_single_swap(k):
    for seed in range(5):
        lon, lat = spots(9, seed)
        d, w = distance_matrix(lon, lat), np.ones(9)
        m = sorted(set(pam(d, k, w).tolist()))
        cost = lambda ms: d[:, list(ms)].min(1).sum()
        assert cost(m) <= min(cost(set(m) - {a} | {b}) for a in m for b in range(9)) + 1e-9
        assert cost(m) <= 1.3 * min(cost(c) for c in combinations(range(9), k)) + 1e-9


def test_silhouettes():
    x = np.array([0.0, 1.0, 10.0, 11.0, 11.0])
    d = np.abs(x[:, None] - x)
    label = np.array([1, 1, 2, 2, 2])
    want = []
    for i in range(5):
        own = [j for j in range(5) if label[j] == label[i] and j != i]
        other = [j for j in range(5) if label[j] != label[i]]
        a, b = d[i, own].mean(), d[i, other].mean()
        want.append((b - a) / max(a, b))
    assert silhouette(d, label, np.ones(5)) == pytest.approx(np.mean(want))
    # two items at one position are one with weight two
    assert silhouette(d[:4, :4], label[:4], np.array([1, 1, 1, 2.0])) == pytest.approx(np.mean(want))
    assert np.isnan(silhouette(d, np.ones(5), np.ones(5)))
    assert silhouette(d[:3, :3], np.array([1, 1, 2]), np.ones(3)) == pytest.approx((2 * 0 + sum((b - 1) / b for b in (10, 9))) / 3)


def test_matching_is_the_largest():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m = map(int, rng.integers(1, 6, 2))
        edges = [(a, b) for a in range(n) for b in range(10, 10 + m) if rng.random() < 0.4]
        got = match_pairs(edges)
        assert all((a, b) in edges for a, b in got.items()) and len(set(got.values())) == len(got)
        best = max(sum((a, b) in edges for a, b in zip(range(n), p)) for p in permutations([*range(10, 10 + m), *[None] * n], n))
        assert len(got) == best
    assert match_pairs([]) == {}


def test_t_distribution():
    # two-sided tail values of tables
    for t, df, p in ((12.706, 1, 0.05), (2.228, 10, 0.05), (2.042, 30, 0.05), (3.169, 10, 0.01), (0.0, 5, 1.0)):
        assert t_two_sided(t, df) == pytest.approx(p, abs=2e-4)
    assert t_two_sided(None, 3) is None
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248) and incomplete_beta(2, 3, 1.0) == 1.0


def test_distance_known():
    assert float(np_haversine_m(0.0, 0.0, 0.0, 1.0)) == pytest.approx(111319.49, abs=0.01)
