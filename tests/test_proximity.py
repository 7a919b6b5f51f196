"""Radius joins, nearest objects and regions against brute force, at the date line, the poles, and beyond the broadcast size."""

import numpy as np
import pytest

from pathloom.functions.geo import np_haversine_m
from pathloom.operators import proximity
from pathloom.operators.proximity import in_regions, near_points, nearest, radius_counts, radius_join, rings_of, visit_match

PLACES = [(-89.4, 43.0), (179.9995, 10.0), (-179.9995, 10.0), (0.0, 89.9995), (120.0, -89.5), (10.0, 0.0)]


def scattered(n, spread, seed, first=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lon, lat = PLACES[i % len(PLACES)]
        lon += rng.normal(0, spread) / max(np.cos(np.radians(min(abs(lat), 89.99))), 1e-3)
        lat = float(np.clip(lat + rng.normal(0, spread), -90, 90))
        out.append((first + i, float((lon + 180) % 360 - 180), lat, "ab"[i % 2], "x"))
    return out


def frames(spark, seed=1):
    pts, obj = scattered(240, 0.0008, seed), scattered(90, 0.0008, seed + 1)
    p = spark.createDataFrame([*pts, (900, None, 1.0, "a", "x"), (None, 1.0, 1.0, "a", "x")], "pid int, lon double, lat double, kind string, spots string").drop("kind")
    o = spark.createDataFrame([*obj, obj[0], (901, None, 1.0, "a", "x")], "oid int, olon double, olat double, kind string, ix string")
    return pts, obj, p, o


def pairs(pts, obj, radius):
    return {(p[0], o[0]) for p in pts for o in obj if np_haversine_m(p[1], p[2], o[1], o[2]) <= radius}


@pytest.mark.parametrize("limit", [1 << 30, 0])
@pytest.mark.parametrize("radius", [30.0, 120.0])
def test_near_points(spark, monkeypatch, radius, limit):
    import pathloom.session as session

    monkeypatch.setattr(proximity, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(session, "BROADCAST_BYTES", limit)
    pts, obj, p, o = frames(spark)
    want = pairs(pts, obj, radius)
    assert len(want) > 20
    assert {tuple(r) for r in near_points(p, o, "pid", ["oid"], radius, object_lon="olon", object_lat="olat").collect()} == want
    assert {(r["pid"], r["oid"]) for r in radius_join(p.filter("pid IS NOT NULL"), o, radius).collect()} == want
    assert near_points(p.limit(0), o, "pid", ["oid"], radius, object_lon="olon", object_lat="olat").count() == 0
    assert near_points(p, o.limit(0), "pid", ["oid"], radius, object_lon="olon", object_lat="olat").count() == 0


def test_nearest_however_far(spark):
    pts, obj, p, o = frames(spark, 5)
    got = {(r["pid"], r["kind"]): r["dist_m"] for r in nearest(p, o, "pid", "kind", ["oid"], start_m=50.0).collect()}
    assert len(got) == 2 * len(pts)
    for q in pts:
        for k in "ab":
            assert got[q[0], k] == pytest.approx(min(float(np_haversine_m(q[1], q[2], x[1], x[2])) for x in obj if x[3] == k), abs=1e-3)


def test_counts_have_zeros_and_grow_with_the_radius(spark):
    pts, obj, p, o = frames(spark, 7)
    got = {r["pid"]: r for r in radius_counts(p, o.dropDuplicates(["oid"]), "pid", "kind", ["a", "b"], [40.0, 90.0]).collect()}
    assert set(got) == {q[0] for q in pts} | {900}
    for q in pts:
        for k in "ab":
            d = [np_haversine_m(q[1], q[2], x[1], x[2]) for x in obj if x[3] == k]
            assert (got[q[0]][f"n_{k}_40"], got[q[0]][f"n_{k}_90"]) == (sum(x <= 40 for x in d), sum(x <= 90 for x in d))
    assert got[900]["n_a_90"] == 0


def test_visit_match_takes_the_first_of_the_nearest(spark):
    # six objects nearer by degrees than the one within reach: the cap of five hides it
    p = spark.createDataFrame([(1, -89.0, 60.0), (2, -80.0, 60.0)], "pid int, lon double, lat double")
    o = spark.createDataFrame([*((i, -89.0, 60.0 + 0.00055 + i * 1e-6, "far") for i in range(6)), (50, -89.0 + 0.0007, 60.0, "near"), (60, -80.0, 60.0001, "north"), (61, -80.0001, 60.0, "west")], "oid int, olon double, olat double, type string")
    assert visit_match(p, o, "pid", ["oid"], ["type"]).select("pid", "type").collect() == [(2, "north")]
    assert {r["pid"]: r["type"] for r in visit_match(p, o, "pid", ["oid"], ["type"], candidates=7).collect()} == {1: "near", 2: "north"}


RING = "((-89.5 42.8, -89.1 42.85, -89.0 43.3, -89.45 43.2, -89.5 42.8), (-89.3 43.0, -89.2 43.0, -89.2 43.1, -89.3 43.1, -89.3 43.0))"
REGIONS = [(1, f"POLYGON {RING}"), (2, f"SRID=4326;MULTIPOLYGON ({RING}, ((-88.9 42.9, -88.8 42.9, -88.85 43.0, -88.9 42.9)))"), (3, None), (4, "POINT (1 2)"), (5, "POLYGON ((bad))"), (1, f"POLYGON {RING}"), (6, "POLYGON ((-120 20, -60 20, -60 60, -120 60, -120 20))"), (7, "POLYGON ((-89.25 43.02, -89.2499 43.02, -89.2499 43.0201, -89.25 43.02))")]


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_points_in_regions(spark, monkeypatch, limit):
    monkeypatch.setattr(proximity, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(3)
    pts = [(i, float(x), float(y), 1) for i, (x, y) in enumerate(zip(rng.uniform(-89.6, -88.7, 500), rng.uniform(42.7, 43.4, 500), strict=True))]
    p = spark.createDataFrame([*pts, (900, None, 43.0, 1), (901, -89.2, 42.95, 1)], "pid int, lon double, lat double, level int")
    r = spark.createDataFrame(REGIONS, "rid int, geom string")

    def inside(x, y, wkt):
        n = 0
        for a in rings_of(wkt):
            for (x1, y1), (x2, y2) in zip(a[:-1], a[1:], strict=True):
                n += (x1 > x) != (x2 > x) and y1 + (x - x1) / (x2 - x1) * (y2 - y1) > y
        return n % 2 == 1

    want = {(q[0], k) for q in [*pts, (901, -89.2, 42.95)] for k, g in REGIONS if inside(q[1], q[2], g)}
    got = [tuple(x) for x in in_regions(p, r, "pid", ["rid"]).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 600
    assert in_regions(p.limit(0), r, "pid", ["rid"]).count() == 0 == in_regions(p, r.limit(0), "pid", ["rid"]).count()
