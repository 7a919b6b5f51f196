"""Sampling by movement over more rows than a slice has, where the app is a column without nulls, and over odd gaps."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pathloom.operators.mobility import sampling_by_movement
from pathloom.operators.ordered import SLICE_ROWS, numbered, with_previous


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Subject 1 rests, subject 2 moves 100 m a fix; some fixes name no app."""
    d = str(tmp_path_factory.mktemp("sampling"))
    rows = spark.range(0, SLICE_ROWS + 50_000, 1, 4).selectExpr("id AS point_id", "cast(id % 2 + 1 AS smallint) AS subid", "43 + (id % 2) * (id % 4000) * 0.0005 AS lat", "-89D AS lon", "cast(timestamp_seconds(1400000000 + id * if(id % 2 = 0, 50, 20)) AS timestamp_ntz) AS time", "if(id % 10 < 2, null, 'one') AS app_source")
    rows.write.parquet(f"{d}/raw_gps.parquet")
    return d


def same_as_sql(spark, name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW raw_gps AS SELECT * FROM '{folder}/raw_gps.parquet/*.parquet'")
    got = entry.queries()[name](spark, folder)
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, got.select(*(c[0] for c in con.description)).collect())) == sorted(want)
    return {r["app"]: r for r in got.collect()}


@pytest.mark.parametrize("n_rows", [1, 10**6])
def test_columns_without_nulls(spark, n_rows):
    df = spark.range(10).selectExpr("id % 2 AS g", "id", "array(id) AS list", "struct(id) AS pair")
    assert not df.schema["list"].nullable
    got = {r["id"]: (r["list"], r["pair"]["id"], r["prev_id"]) for r in with_previous(df, "g", ["id"], ["id"], n_rows=n_rows).collect()}
    assert got == {i: ([i], i, i - 2 if i > 1 else None) for i in range(10)}


def test_adaptive_sampling_of_many_rows(spark, folder):
    got = same_as_sql(spark, "k6_adaptive_sampling", folder)
    assert {k: r["ratio"] for k, r in got.items()} == {"one": 2.5, "none": 2.5}


def test_gaps_of_many_rows(spark, folder):
    got = same_as_sql(spark, "k6_gaps_by_movement", folder)
    assert sorted(got) == ["none", "one"]


def test_gaps_that_all_differ(spark, tmp_path_factory):
    """Times of a microsecond, so hardly two gaps are equal and each group's gaps are in several slices."""
    d = str(tmp_path_factory.mktemp("odd_gaps"))
    rows = spark.range(0, 3 * SLICE_ROWS, 1, 4).selectExpr("id AS point_id", "cast(id % 3 AS smallint) AS subid", "43 + (id % 2) * 0.01 * (id % 5) AS lat", "-89D AS lon", "cast(timestamp_micros(1400000000000000 + id * 30000000 + if(id % 1000 < 3, 5000000000, 0) + pmod(xxhash64(id), 20000000)) AS timestamp_ntz) AS time", "if(id % 7 = 0, null, 'one') AS app_source")
    rows.write.parquet(f"{d}/raw_gps.parquet")
    got = same_as_sql(spark, "k6_gaps_by_movement", d)
    assert sorted(got) == ["none", "one"]
    plan = entry.queries()["k6_gaps_by_movement"](spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan  # these hold all different gaps of a group in one task


def test_gaps_of_few_rows(spark):
    """Apps that are null, have one gap, only long gaps, or no gap at all."""
    fixes = [(None, 1, 0), (None, 1, 60), (None, 1, 180), ("one", 2, 0), ("one", 2, 30), ("long", 3, 0), ("long", 3, 4000), ("long", 3, 9000), ("none", 4, 0)]
    df = spark.createDataFrame([(k, s, 43.0, -89.0, t, a) for k, (a, s, t) in enumerate(fixes)], "point_id long, subid short, lat double, lon double, t long, app_source string").withColumn("time", F.timestamp_seconds("t").cast("timestamp_ntz")).drop("t")
    gaps, ratios = sampling_by_movement(df)
    got = {r["app"]: (r["n_points"], r["q25"], r["median_gap"], r["max_gap"], r["mean_gap"], r["n_excluded"], r["q95_all"]) for r in gaps.collect()}
    assert got == {None: (2, 75, 90, 120, 90, 0, 117), "one": (1, 30, 30, 30, 30, 0, 30), "long": (0, None, None, None, None, 2, 4950)}
    assert {r["app"]: (r["stationary"], r["ratio"]) for r in ratios.collect()} == {None: (90, None), "one": (30, None), "long": (None, None)}


@pytest.mark.parametrize("n_rows", [1, 10**6])
def test_numbers_of_rows_that_stand_for_several(spark, n_rows):
    df = spark.range(30).selectExpr("29 - id AS x", "id % 4 AS n")
    got = {r["x"]: r["at"] for r in numbered(df, ["x"], n_rows=n_rows, name="at", start=0, weight="n").collect()}
    assert got == {x: sum((29 - y) % 4 for y in range(x)) for x in range(30)}
