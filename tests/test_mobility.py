"""Steps, quality rules, stays, windows and entropy at their boundaries; places and their scores on small frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions.geo import EARTH_M, MILE_M
from pathloom.operators import mobility as M
from pathloom.operators import places as L
from pathloom.operators.tests_of_means import paired_t, welch_t

STEP = float(np.degrees(1 / EARTH_M))  # a metre of latitude


def pings(spark, rows, extra="1 AS us"):
    df = spark.createDataFrame([(i, s, None if n is None else 43.0 + n * STEP, -89.0, t) for i, (s, n, t) in enumerate(rows)], "point_id long, subid int, lat double, lon double, sec long")
    return df.selectExpr("point_id", "subid", "lat", "lon", "cast(timestamp_seconds(sec + 1400000000) AS timestamp_ntz) AS time", extra)


def test_steps_and_rules(spark):
    mile = MILE_M
    rows = [(1, 0, 0), (1, 0.005 * mile, 0), (1, 0.1 * mile, 0), (1, 0.2 * mile, 60), (1, 1.2 * mile, 96.0), (1, 2.3 * mile, 132), (1, 2.5 * mile, 133), (2, 0, 5), (None, 0, 6), (3, None, 7), (1, 2.5 * mile, None)]
    s = M.step_metrics(M.valid_fixes(pings(spark, [(a, b, None if t is None else int(t)) for a, b, t in rows])))
    got = {r["point_id"]: r for r in s.collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 6, 7}
    assert (got[0]["dist_m"], got[0]["speed_mph"], got[7]["dist_m"]) == (0, 0, 0)
    assert got[2]["speed_mph"] == 0 and got[2]["dist_miles"] == pytest.approx(0.095)
    assert got[4]["speed_mph"] == pytest.approx(100) and got[5]["speed_mph"] == pytest.approx(110)
    kept = {r["point_id"] for r in M.quality_filter(s).collect()}
    assert kept == {0, 1, 3, 7}  # moved in no time; far in a step; too fast
    assert {r["point_id"] for r in M.quality_filter(s, "short_gap").collect()} - {4} == {0, 1, 3, 7}
    assert {r["metric"]: r["n"] for r in M.filter_impact(s, M.quality_filter(s)).collect()} == {"before": 8, "after": 4, "removed": 4}
    c = {r["point_id"]: r["movement_state"] for r in M.movement_class(s).collect()}
    assert c[0] == "stationary" and c[3] == "transition"


@pytest.mark.parametrize("slice_rows", [10**6, 5])
def test_stays_at_their_limits(spark, slice_rows):
    m = 60
    rows = [(1, 0, 0), (1, 49.9, 5 * m), (1, 20, 10 * m)]  # exactly ten minutes
    rows += [(1, 80, 11 * m), (1, 80, 20 * m)]  # a jump parts; nine minutes are too short
    rows += [(1, 200, 30 * m), (1, 200, 90 * m), (1, 201, 151 * m)]  # 60 minutes don't part, 61 do
    rows += [(2, 0, 0), (2, 0, 720 * m * 0 + 60 * m), *[(2, 0, 60 * m * k) for k in range(2, 13)], (3, 5, 0)]
    fixes = M.localise(pings(spark, rows))
    got = M.detect_stays(fixes, "point_id", slice_rows=slice_rows).orderBy("stay_id").collect()
    assert [(r["stay_id"], r["subid"], r["dwell_mins"], r["n_points"]) for r in got] == [(1, 1, 10.0, 3), (2, 1, 60.0, 2), (3, 2, 720.0, 13)]
    assert got[0]["lat"] == pytest.approx(43 + 20 * STEP, abs=1e-12)
    assert str(got[0]["start_time"]) == "2014-05-13 11:53:20"  # the subject's own clock
    assert M.detect_stays(fixes.limit(0), "point_id").count() == 0
    assert M.detect_stays(fixes, "point_id", max_hours=11.9).count() == 2


def stays(spark, rows):
    df = spark.createDataFrame(rows, "stay_id int, subid int, day int, minutes double, cluster_id int")
    return df.selectExpr("stay_id", "subid", "cast(date_add(DATE'2024-01-01', day) AS timestamp_ntz) AS start_time", "minutes AS dwell_mins", "cluster_id")


def test_entropy(spark):
    s = stays(spark, [(1, 1, 0, 60.0, 1), (2, 1, 0, 60.0, 2), (3, 1, 0, 10.0, 0), (4, 1, 1, 5.0, 1), (5, 1, 6, 60.0, 1), (6, 1, 6, 30.0, 2), (7, 1, 6, 30.0, 2), (8, 1, 7, 1.0, 1), (9, 2, 0, 60.0, 1)])
    d = M.daily_entropy(s).collect()
    assert [(str(r["date"]), r["n_stays"], r["n_clusters"]) for r in sorted(d, key=lambda r: r["date"])] == [("2024-01-01", 3, 2), ("2024-01-07", 3, 2)]
    assert min(r["location_entropy"] for r in d) == pytest.approx(math.log(2))
    r = {str(x["date"]): x for x in M.rolling_entropy(s).collect()}
    assert set(r) == {"2024-01-07", "2024-01-08"}
    assert r["2024-01-08"]["n_stays"] == 5  # the first day has left
    p = np.array([125, 120]) / 245
    assert r["2024-01-07"]["location_entropy"] == pytest.approx(-(p * np.log(p)).sum()) and r["2024-01-07"]["n_stays"] == 6
    assert 0 <= r["2024-01-07"]["normalized_entropy"] <= 1
    w = M.cumulative_windows(s).collect()
    assert sorted(x["stay_id"] for x in w) == [1, 2, 3, 4, 5, 6, 7] and {x["window_days"] for x in w} == {7}


def test_reports(spark):
    t = spark.createDataFrame([(1, 100, 43.0, -89.0, "Home"), (1, 100, 43.0, -89.0, "home"), (1, 500, 43.0 + 40 * STEP, -89.0, None), (1, 600, 43.0 + 80 * STEP, -89.0, "bar"), (1, 700, 43.0 + 400 * STEP, -89.0, "gym"), (2, None, 43.0, -89.0, "gym"), (2, 5, None, None, "x")], "subid int, utc long, lat double, lon double, type string")
    f = M.intake_flag(t)
    assert sorted(r["intake"] for r in f.collect()) == [0, 0, 0, 0, 1, 1, 1]
    d = L.dedupe_locations(f).orderBy("subid", "location_id").collect()
    assert [(r["subid"], r["location_id"], r["n_reports"], r["intake"], r["types"]) for r in d] == [(1, 1, 4, 1, "bar, home"), (1, 2, 1, 0, "gym"), (2, 1, 1, 0, "gym")]
    assert d[0]["lat"] == pytest.approx(43 + 20 * STEP, abs=1e-12)


def test_scores(spark):
    at = lambda i, s, m: (s, i, 43.0 + m * STEP, -89.0)
    places = spark.createDataFrame([at(1, 1, 0), at(2, 1, 90), at(3, 1, 5000), at(1, 2, 0)], "subid int, cluster_id int, lat double, lon double")
    truth = spark.createDataFrame([at(1, 1, 60), at(2, 1, 9000), at(1, 3, 0)], "subid int, location_id int, lat double, lon double")
    nn = L.capture(places, truth).collect()
    assert [(r["subid"], r["precision"], r["recall"]) for r in nn] == [(1, pytest.approx(2 / 3), 0.5)]
    one = L.capture(places, truth, one_to_one=True).first()
    assert (one["matched_places"], one["recall"]) == (1, 0.5) and one["f1"] == pytest.approx(0.4)
    far = L.capture(places, truth, radius_m=1.0).first()
    assert (far["precision"], far["recall"], far["f1"]) == (0, 0, 0)
    c = {r["subid"]: (r["n_concordant"], r["n_a_only"], r["n_b_only"]) for r in L.concordance(places, truth, ["subid"]).collect()}
    assert c == {1: (1, 2, 1), 2: (0, 1, 0), 3: (0, 0, 1)}


def test_clusters_of_stays(spark):
    df = spark.createDataFrame([(i, s, 43.0 + m * STEP, -89.0) for i, (s, m) in enumerate([(1, 0), (1, 30), (1, 500), (1, 530), (1, 2000), (2, 0), (3, 0), (3, 200)])], "stay_id int, subid int, lat double, lon double")
    got = {r["stay_id"]: r["cluster_id"] for r in L.cluster_stays(df).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 2, 4: 0, 5: 1, 6: 0, 7: 0}
    assert {r["stay_id"]: r["cluster_id"] for r in L.cluster_stays(df, singleton="noise").collect()}[5] == 0
    k = {r["stay_id"]: (r["cluster_id_kmeans"], r["optimal_k"]) for r in L.medoid_clusters(df, 2, 20, fallback=True).collect()}
    assert k[0] == k[1] == (1, 3) and k[2] == k[3] == (2, 3) and k[4] == (3, 3) and k[5] == (1, 1)
    assert L.cluster_stays(df.limit(0)).count() == 0


def test_means(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1), (2.0, 4.0, 1), (3.0, 5.0, 0), (None, 1.0, 0)], "x double, y double, g int")
    r = paired_t(df, "x", "y").first()
    assert (r["n_x"], r["df"]) == (3, 2) and r["t"] == pytest.approx(-5.0) and r["p"] == pytest.approx(0.03775, abs=1e-4) and r["label"] == "significant at .05"
    w = welch_t(df, "y", F.col("g") == 1).first()
    assert w["t"] == pytest.approx(0.0) and w["df"] == pytest.approx((1 + 4) ** 2 / (1 + 16))
    assert paired_t(df.limit(0), "x", "y").first()["t"] is None and welch_t(df.limit(1), "y", F.col("g") == 1).first()["t"] is None
