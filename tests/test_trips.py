"""Stops and trips don't depend on how the fixes are cut into slices."""

import pandas as pd
import pytest

from pathloom.operators.trips import stops_and_trips


def days(n_days: int = 12) -> pd.DataFrame:
    """Days of a stop, a way of long steps and a stop, then a phone that is off overnight where it was."""
    rows, t = [], pd.Timestamp("2024-01-01 08:00")
    for day in range(n_days):
        a, b = (0.0, 0.02) if day % 2 == 0 else (0.02, 0.0)
        for lat in [41.7 + a] * 13 + [41.7 + a + (b - a) * i / 8 for i in range(1, 8)] + [41.7 + b] * 13:
            rows.append((len(rows), 1, lat, -88.0, t))
            t += pd.Timedelta(minutes=1)
        t += pd.Timedelta(hours=9)
    return pd.DataFrame(rows, columns=["processed_id", "subid", "lat", "lon", "time"])


@pytest.fixture(scope="module")
def gps(spark):
    return spark.createDataFrame(days()).selectExpr("processed_id", "cast(subid AS smallint) AS subid", "lat", "lon", "cast(time AS timestamp_ntz) AS time").cache()


def rows_of(gps, slice_rows):
    r = stops_and_trips(gps, slice_rows=slice_rows).toPandas()
    return sorted((x.kind, x.start_id, x.end_id, x.n_fixes, round(x.distance_m, 3)) for x in r.itertuples())


def test_one_slice_parts_trips_at_silences(gps):
    r = rows_of(gps, 10**6)
    assert sum(x[0] == "stop" for x in r) == 24
    trips = [x for x in r if x[0] == "trip"]
    assert [(x[1], x[2]) for x in trips] == sorted((33 * d + 12, 33 * d + 20) for d in range(12))
    assert all(abs(x[4] - 2226.39) < 0.01 and x[3] == 8 for x in trips)


@pytest.mark.parametrize("slice_rows", [150, 33, 11])
def test_all_slicings_give_the_same_rows(gps, slice_rows):
    assert rows_of(gps, slice_rows) == rows_of(gps, 10**6)


def test_dense_fixes_are_cut_within_moves(spark):
    """A fix a second: no step is long and nothing is silent, so slices are cut where windows let them."""
    import numpy as np

    from pathloom.operators.trips import stop_kernel

    rng = np.random.default_rng(6)
    pace = np.repeat([0.0, 12.0, 0.0, 1.1, 0.0, 20.0, 0.0], [900, 300, 700, 900, 500, 200, 800])
    north = np.cumsum(pace) + rng.normal(0, 3, len(pace))
    p = pd.DataFrame({"processed_id": np.arange(len(pace)), "subid": 1, "lat": 41.7 + np.degrees(north / 6378137.0), "lon": -88 + rng.normal(0, 3e-5, len(pace)), "time": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(len(pace)), "s")})
    gps = spark.createDataFrame(p).selectExpr("processed_id", "cast(subid AS smallint) AS subid", "lat", "lon", "cast(time AS timestamp_ntz) AS time").cache()
    one = rows_of(gps, 10**6)
    assert sum(x[0] == "stop" for x in one) >= 3 and sum(x[0] == "trip" for x in one) >= 2
    for slice_rows in (2000, 900, 400, 150):
        assert rows_of(gps, slice_rows) == one
    edges, _ = stop_kernel(50.0, 600.0, 3600.0)
    arrays = {"us": np.arange(len(pace)) * 1_000_000, "subid": np.ones(len(pace)), "lat": p.lat.to_numpy(), "lon": p.lon.to_numpy()}
    first, seen, last, back = edges(arrays)
    assert 900 < first < 920 and first < seen < 930 and 4290 - 800 < last < 3540 and back < last
