"""Longest windows against all windows, and the time a long quiet stop takes."""

import time

import numpy as np

from pathloom.functions.geo import EARTH_M, np_haversine_m
from pathloom.operators.trips import longest_windows


def brute(lat, lon, sec, radius, least):
    n = len(lat)
    ok = [[bool((np_haversine_m(lon[i : j + 1, None], lat[i : j + 1, None], lon[i : j + 1], lat[i : j + 1]) <= radius).all()) for j in range(n)] for i in range(n)]
    longest = [(i, j) for i in range(n) for j in range(i, n) if ok[i][j] and not (i > 0 and ok[i - 1][j]) and not (j < n - 1 and ok[i][j + 1])]
    return [(i, j) for i, j in longest if sec[j] - sec[i] >= least]


def test_windows_are_the_longest(monkeypatch):
    from pathloom.operators import trips

    rng = np.random.default_rng(4)
    for block in (3, 256):
        monkeypatch.setattr(trips, "BLOCK", block)
        for k in range(60):
            n = int(rng.integers(1, 30))
            spread = [8, 15, 40][k % 3]
            north, east = np.cumsum(rng.normal(0, spread / 4, n)) + rng.normal(0, spread, n), rng.normal(0, spread, n)
            lat, lon = 44 + np.degrees(north / EARTH_M), -88 + np.degrees(east / EARTH_M) / np.cos(np.radians(44))
            sec = np.cumsum(rng.integers(20, 200, n)).astype(float)
            assert longest_windows(lat, lon, sec, 50.0, 300.0) == brute(lat, lon, sec, 50.0, 300.0)


def test_a_long_quiet_stop_takes_linear_time():
    rng = np.random.default_rng(4)
    n = 200_000
    lat, lon = 44 + rng.normal(0, 4, n).clip(-14, 14) / 111_000, -88 + rng.normal(0, 4, n).clip(-14, 14) / 80_000
    t = time.time()
    assert longest_windows(lat, lon, np.arange(n) * 60.0, 50.0, 600.0) == [(0, n - 1)]
    assert time.time() - t < 20
