"""Places are communities by distance alone, also where the cells' latitude bands meet."""

import numpy as np
import pytest

from pathloom.functions.geo import EARTH_M
from pathloom.operators.trips import _cell, places

SIZE = float(np.degrees(20.0 / EARTH_M))


@pytest.mark.parametrize("lat", [42.0, 41.95, -33.9])
@pytest.mark.parametrize("lon", [-88.0, 151.2])
def test_a_place_on_a_parallel_is_one(spark, lat, lon):
    # 18 m to each side of the parallel, and another place 400 m away
    d = np.degrees(18 / EARTH_M)
    rows = [(1, lat - d, lon, 3), (1, lat + d, lon, 5), (1, lat + np.degrees(400 / EARTH_M), lon, 4)]
    stops = spark.createDataFrame([(s, float(a), float(o), w) for s, a, o, w in rows], "subid long, lat double, lon double, weight long")
    placed = stops.withColumns(dict(zip(("cx", "cy"), _cell("lat", "lon", SIZE), strict=True))).join(places(stops), ["subid", "cx", "cy"])
    by_weight = {r["weight"]: r["place"] for r in placed.collect()}
    assert len(by_weight) == 3
    assert by_weight[3] == by_weight[5] != by_weight[4]
