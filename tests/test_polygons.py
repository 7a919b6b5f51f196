"""Areas, centroids, clipping, overlay and simplification on shapes whose answers are known."""

import numpy as np
import pytest

from pathloom.operators.polygons import area_of, centroid_of, clip_ring, clip_to_grid, map_features, measures, overlaps, overlay_areas, simplify_ring, square_grid, text_of, with_regions
from pathloom.operators.proximity import rings_of


def box(x0, y0, x1, y1, clockwise=False):
    r = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], float)
    return r[::-1] if clockwise else r


@pytest.mark.parametrize("turn", [False, True])
def test_holes_take_area_whatever_their_direction(turn):
    rings = [box(0, 0, 10, 10), box(2, 2, 4, 4, turn), box(20, 0, 21, 2, turn)]
    assert area_of(rings) == pytest.approx(100 - 4 + 2)
    cx, cy = centroid_of(rings)
    assert (cx, cy) == pytest.approx(((500 - 12 + 41) / 98, (500 - 12 + 2) / 98))


def test_centroid_of_nothing_and_of_a_line():
    assert np.isnan(centroid_of([])[0])
    assert centroid_of([np.array([(0, 0), (2, 0), (1, 0), (0, 0)], float)]) == pytest.approx((1.0, 0.0))


def test_clipping():
    ring = np.array([(0, 0), (4, 0), (2, 4), (0, 0)], float)
    whole = sum(area_of([c]) for x in range(4) for y in range(4) if len(c := clip_ring(ring, (x, y, x + 1, y + 1))) > 3)
    assert whole == pytest.approx(8)
    assert len(clip_ring(ring, (10, 10, 11, 11))) == 0


def test_overlay():
    assert overlay_areas([box(0, 0, 4, 4)], [box(2, 2, 6, 6)]) == pytest.approx((4, 12, 12))
    assert overlay_areas([box(0, 0, 10, 10), box(2, 2, 4, 4)], [box(0, 0, 5, 5)]) == pytest.approx((21, 75, 4))
    assert overlay_areas([box(0, 0, 1, 1)], []) == pytest.approx((0, 1, 0))
    assert overlay_areas([], []) == (0, 0, 0)
    tri, other = np.array([(0, 0), (4, 0), (0, 4), (0, 0)], float), np.array([(0, 4), (4, 4), (4, 0), (0, 4)], float)
    assert overlay_areas([tri], [other]) == pytest.approx((0, 8, 8))


def test_simplification_keeps_corners():
    t = np.linspace(0, 1, 50)
    side = lambda a, b: np.outer(1 - t, a) + np.outer(t, b)
    r = np.vstack([side((0, 0), (1, 0)), side((1, 0), (1, 1)), side((1, 1), (0, 1)), side((0, 1), (0, 0))])
    assert len(simplify_ring(r, 0.01)) == 5 and area_of([simplify_ring(r, 0.01)]) == pytest.approx(1)
    assert len(simplify_ring(r, 10.0)) >= 4 and area_of([simplify_ring(r, 10.0)]) > 0


def test_text_round_trip():
    rings = [box(0, 0, 10, 10), box(2, 2, 4, 4), box(20, 0, 21, 2)]
    assert area_of(rings_of(text_of(rings))) == pytest.approx(98) and text_of([]) is None


def test_tables(spark):
    rows = [("W", 1, "a", text_of([box(0, 0, 0.1, 0.1)]), 1), ("W", 2, "b", text_of([box(0.05, 0.05, 0.2, 0.2)]), 1), ("W", 3, None, None, 1), ("W", 1, "a", text_of([box(0, 0, 0.1, 0.1)]), 1), ("R", 4, "d", "nonsense", 1)]
    t = spark.createDataFrame(rows, "osm_type string, osm_id long, name string, geom string, ix int")
    keys = ["osm_type", "osm_id"]
    assert {r["osm_id"]: round(r["cx"], 9) for r in measures(t, keys).collect()} == {1: 0.05, 2: 0.125}
    assert sorted((r["osm_id"], round(r["share"], 9)) for r in clip_to_grid(t, keys, 0.1).collect()) == [(1, 1.0), (2, 0.25), (2, 0.5), (2, 0.5), (2, 1.0)]
    over = overlaps(t, keys).collect()
    assert [(r["osm_id_a"], r["osm_id_b"], round(r["both"], 9), round(r["a_only"], 9)) for r in over] == [(1, 2, 0.0025, 0.0075)]
    p = spark.createDataFrame([(1, 0.07, 0.07), (2, 5.0, 5.0), (3, None, 1.0)], "pid int, lon double, lat double")
    assert sorted((r["pid"], r["name"] or "") for r in with_regions(p, t, "pid", keys, ["name"]).collect()) == [(1, "a"), (1, "b"), (2, ""), (3, "")]
    assert measures(t.limit(0), keys).count() == 0 and overlaps(t.limit(0), keys).count() == 0
    g = square_grid(0, 0, 2.5, 1, 1, spark).collect()
    assert [(r["cell_id"], r["x"], r["y"]) for r in g] == [(1, 0.5, 0.5), (2, 1.5, 0.5), (3, 2.5, 0.5)]


def test_map_rules(spark):
    rows = [("node", 1, {"shop": "wine", "amenity": "bar", "name": "x"}, None), ("node", 2, {"landuse": "retail"}, None), ("way", 3, {"landuse": "retail", "amenity": "bar"}, True), ("way", 4, {"amenity": "cafe"}, False), ("way", 5, {"amenity": "cafe"}, True), ("relation", 6, {"landuse": "forest"}, None), ("node", 7, {}, None), ("way", 8, {"landuse": "forest"}, None)]
    poi, land = map_features(spark.createDataFrame(rows, "kind string, osm_id long, tags map<string,string>, is_closed boolean").selectExpr("*", "'g' AS geom"))
    assert sorted((r["osm_id"], r["osm_type"], r["class"], r["type"]) for r in poi.collect()) == [(1, "N", "amenity", "bar"), (5, "W", "amenity", "cafe")]
    assert sorted((r["osm_id"], r["type"]) for r in land.collect()) == [(3, "retail"), (6, "forest")]
