"""Clusters against the definition by brute force, and what the mixture decides."""

import numpy as np
import pandas as pd
import pytest

from pathloom.functions.geo import EARTH_M, np_haversine_m
from pathloom.llm import clusters
from pathloom.llm.clusters import ClusterRules, cluster_members, place_clusters, tile_clusters
from pathloom.operators.graph import components


def fixes(seed: int) -> pd.DataFrame:
    """Places of several widths and distances, strays and exact repeats; subject 1 holds most rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for subid, n_places in ((1, 14), (2, 4), (3, 1)):
        for _ in range(n_places):
            north, east = rng.uniform(-900, 900, 2)
            n, wide = int(rng.integers(3, 60)), rng.choice([3.0, 8.0, 12.0])
            rows += [(subid, north + a, east + b) for a, b in rng.normal(0, wide, (n, 2)).clip(-2 * wide, 2 * wide)]
            if rng.random() < 0.4:  # a second lobe, in or beyond reach
                at = rng.uniform(20, 110)
                rows += [(subid, north + at + a, east + b) for a, b in rng.normal(0, 2, (12, 2))]
        rows += [(subid, *rng.uniform(-900, 900, 2)) for _ in range(5)]
    rows += rows[:15]
    p = pd.DataFrame(rows, columns=["subid", "n", "e"])
    p["lat"], p["lon"] = 43.02 + np.degrees(p.n / EARTH_M), -88.98 + np.degrees(p.e / EARTH_M) / np.cos(np.radians(43.02))
    p["processed_id"] = rng.permutation(len(p)) + 100
    return p[["processed_id", "subid", "lat", "lon"]].round({"lat": 6, "lon": 6})


def brute(p: pd.DataFrame) -> set:
    out = set()
    for _, q in p.groupby("subid"):
        lat, lon, ids = q.lat.to_numpy(), q.lon.to_numpy(), q.processed_id.to_numpy()
        d = np_haversine_m(lon[:, None], lat[:, None], lon, lat)
        root = components(len(q), *np.nonzero(d <= 80))
        for r in np.unique(root):
            m = root == r
            if m.sum() >= 10 and d[np.ix_(m, m)].max() <= 50:
                out |= {(int(ids[m].min()), int(i)) for i in ids[m]}
    return out


def table(spark, p):
    return spark.createDataFrame([(int(r.processed_id), int(r.subid), float(r.lat), float(r.lon), 1) for r in p.itertuples()] + [(1, 1, None, -89.0, 1), (2, None, 43.0, -89.0, 1)], "processed_id long, subid int, lat double, lon double, n int")


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_members_are_those_of_the_definition(spark, seed):
    p = fixes(seed)
    gps = table(spark, p)
    got = {(r["cluster_key"], r["processed_id"]) for r in cluster_members(gps, place_clusters(gps)).collect()}
    want = brute(p)
    assert got == want and len(want) > 30


def test_no_fixes(spark):
    gps = table(spark, fixes(1).iloc[:0])
    assert place_clusters(gps).count() == 0 and cluster_members(gps, place_clusters(gps)).count() == 0


def arrays(p):
    q = p[p.subid == 1].groupby(["lat", "lon"], as_index=False).agg(n=("processed_id", "size"), pid=("processed_id", "min"))
    cols = {c: q[c].to_numpy() for c in ("lat", "lon", "n", "pid")}
    cols["subid"] = np.ones(len(q), int)
    cols["ty"], cols["tx"] = np.floor(q.lat / clusters.TILE_LAT).to_numpy().astype(int), np.floor(q.lon / clusters.TILE_LON).to_numpy().astype(int)
    keep = (cols["ty"] == cols["ty"][0]) & (cols["tx"] == cols["tx"][0])
    return {c: v[keep] for c, v in cols.items()}


def test_the_mixture_decides_the_candidates(monkeypatch):
    every = [arrays(fixes(seed)) for seed in range(1, 13)]
    found = lambda rules: {(i, k) for i, a in enumerate(every) for k in tile_clusters(a, rules)["cluster_key"]}
    whole = found(ClusterRules())
    # two tight lobes of one place: with a floor far below the diameter the criterion keeps them apart
    rng = np.random.default_rng(1)
    north, east = np.r_[rng.normal(0, 0.7, 200), rng.normal(46, 0.7, 200)].clip(-1, 47) + 500, rng.normal(0, 0.7, 400)
    place = arrays(pd.DataFrame({"subid": 1, "lat": 43.0 + np.degrees(north / EARTH_M), "lon": -88.997 + np.degrees(east / EARTH_M), "processed_id": np.arange(400)}))
    assert tile_clusters(place, ClusterRules())["size"] == [400]
    assert tile_clusters(place, ClusterRules(spread_m=0.5))["size"] == []
    # every cell a component of its own
    monkeypatch.setattr(clusters, "_mixture", lambda comp, *a: (np.arange(len(comp)), np.zeros(len(comp))))
    assert found(ClusterRules()) < whole
