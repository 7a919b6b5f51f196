"""Implausible readings: each kind, decided by its method, and the same rows whatever the slices."""

import numpy as np
import pandas as pd
import pytest

from pathloom.functions.geo import EARTH_M, MILE_M, np_haversine_m
from pathloom.operators.readings import ReadingRules, details, implausible_readings

COLUMNS = "processed_id long, subid smallint, time timestamp_ntz, lat double, lon double, speed_mph double, dist_miles double, kind string"


def walk(n=600, subid=1, first=0, seed=0, home=0.5):
    """A subject that rests and drives by turns, a fix a minute, with right metrics."""
    rng = np.random.default_rng(seed)
    v = np.where((np.arange(n) // 30) % 2 == 0, 0.0, 0.35)  # miles a minute
    north = np.cumsum(v * np.where((np.arange(n) // 60) % 2 == 0, 1, -1)) + rng.normal(0, 0.002, n)
    lat, lon = 43 + np.degrees(north * MILE_M / EARTH_M), -89 + rng.normal(0, 2e-5, n)
    p = pd.DataFrame({"processed_id": first + np.arange(n), "subid": subid, "time": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), "min"), "lat": lat.round(6), "lon": lon.round(6)})
    return metrics(p)


def metrics(p):
    d = np.r_[0, np_haversine_m(p.lon[:-1].to_numpy(), p.lat[:-1].to_numpy(), p.lon[1:].to_numpy(), p.lat[1:].to_numpy())] / MILE_M
    h = np.r_[np.nan, np.diff(p.time.to_numpy()).astype(float) / 3.6e12]
    return p.assign(dist_miles=d.round(4), speed_mph=np.nan_to_num(d / h).round(2), kind="x")


def found(spark, p, rules=ReadingRules(), **how):
    rows = [tuple(None if v is None or v != v else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in p[["processed_id", "subid", "time", "lat", "lon", "speed_mph", "dist_miles", "kind"]].astype(object).itertuples(index=False, name=None)]
    got = implausible_readings(spark.createDataFrame(rows, COLUMNS), rules, **how).collect()
    return {(r["processed_id"], r["measure"]): r["kind"] for r in got}


def test_right_readings_are_left_alone(spark):
    assert found(spark, walk()) == {}


def test_each_kind(spark):
    p = walk()
    p.loc[100, "speed_mph"] = 88.0  # far beyond its step
    p.loc[150, "dist_miles"] = 2.2
    p.loc[200, "speed_mph"] = -1.0
    p.loc[250, "dist_miles"] = None
    p.loc[330:336, "speed_mph"] = p.loc[330, "speed_mph"]  # stuck
    p.loc[400, "lat"] = 143.0
    p.loc[500, "lat"] += 0.2  # leaps away, and the metrics follow
    follow = metrics(p)
    p.loc[500:501, ["dist_miles", "speed_mph"]] = follow.loc[500:501, ["dist_miles", "speed_mph"]]
    got = found(spark, p)
    want = {(100, "speed_mph"): "spike", (150, "dist_miles"): "spike", (200, "speed_mph"): "bound", (400, "lat"): "bound", (500, "lat"): "spike"}
    want |= {(i, "speed_mph"): "stuck" for i in range(331, 337)}
    for i in (500, 501):
        want |= {(i, m): "bound" if m == "x" else "leap" for m in ("speed_mph", "dist_miles")}
    assert got == want


def test_the_wavelet_decides_spikes(spark):
    p = walk()
    p.loc[100, "speed_mph"] = 88.0
    p.loc[135, "speed_mph"] = p.loc[135, "speed_mph"] + 0.1  # contradicts its step, but isn't far beyond anything
    assert found(spark, p) == {(100, "speed_mph"): "spike"}
    assert found(spark, p, ReadingRules(spike_scale=0.0)).keys() == {(100, "speed_mph"), (135, "speed_mph")}
    assert found(spark, p, ReadingRules(spike_scale=1e9)) == {}


def test_details_see_spikes_and_not_slopes():
    row = np.arange(50)
    d = details(np.arange(50.0), np.zeros(50), row)
    assert np.allclose(d[:, 8:-8], 0)
    x = np.zeros(50)
    x[25] = 8
    d = details(x, np.zeros(50), row)
    assert d[0].argmax() == 25 and d[0, 25] == 4
    assert details(np.zeros(0), np.zeros(0), np.zeros(0)).shape == (3, 0)


def test_rows_processed_twice_and_nulls(spark):
    p = walk(300)
    p.loc[100, "speed_mph"] = 88.0
    again = p.loc[[100]].assign(processed_id=9000)
    bare = p.loc[[100]].assign(processed_id=9001, speed_mph=None)
    lost = p.loc[[50]].assign(processed_id=9002, subid=None)
    assert found(spark, pd.concat([p, again, bare, lost])) == {(100, "speed_mph"): "spike", (9000, "speed_mph"): "spike"}
    assert found(spark, p.iloc[:0]) == {}
    assert found(spark, p.iloc[:1]) == {}


@pytest.mark.parametrize("n", [400, 2000])
def test_a_stuck_latitude_longer_than_any_slice(spark, n):
    # one latitude, moving on only every 60 fixes
    p = pd.DataFrame({"processed_id": np.arange(n), "subid": 1, "time": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), "min"), "lat": 43.0, "lon": -89 + np.arange(n) // 60 * 0.001})
    p = metrics(p)
    want = {(i, "lat") for i in range(1, n)}
    for slice_rows in (10**6, n // 5, n // 10):
        assert {k for k in found(spark, p, slice_rows=slice_rows) if k[1] == "lat"} == want


def test_the_same_rows_whatever_the_slices(spark):
    rng = np.random.default_rng(5)
    parts = [walk(3000, 1, 0, 1), walk(500, 2, 5000, 2), walk(20, 3, 6000, 3)]
    for p in parts:
        n = len(p)
        p.loc[rng.choice(n, n // 50), "speed_mph"] *= 9
        p.loc[rng.choice(n, n // 50), "lat"] += 0.3
        p.loc[rng.choice(n, n // 10), "dist_miles"] = None
        for s in rng.choice(n, 6):
            p.loc[s : s + int(rng.integers(3, 400)), "dist_miles"] = 0.123
    p = pd.concat(parts)
    p = pd.concat([p, p.sample(60, random_state=1).assign(processed_id=lambda x: x.processed_id + 100_000)])
    one = found(spark, p, slice_rows=10**6)
    assert len(one) > 500
    for slice_rows in (1500, 700, 90):
        assert found(spark, p, slice_rows=slice_rows) == one
