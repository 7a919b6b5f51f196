"""Readers, sinks, table operators and sessions of small frames: nulls, ties, empty tables, clashing names."""

import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathloom.functions import taxonomy as X
from pathloom.operators import relational as rel
from pathloom.operators.ordered import numbered, with_previous
from pathloom.operators.sessions import sessions
from pathloom.sources import catalog, files, layers


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame([(1, "a", 3.0), (1, "b", 3.0), (1, None, 1.0), (None, "c", 5.0), (None, "d", None), (2, "e", None)], "g int, name string, x double")


def test_groups(t):
    pick = lambda df: sorted((r["g"] or 0, r["name"] or "") for r in df.collect())
    assert pick(rel.in_largest_value(t, ["g"], "x")) == [(0, "c"), (1, "a"), (1, "b")]
    assert pick(rel.in_largest_value(t, ["g"], "x", largest=False)) == [(0, "c"), (1, "")]
    assert pick(rel.first_per_group(t, ["g"], [F.desc_nulls_last("x"), F.asc_nulls_last("name")])) == [(0, "c"), (1, "a"), (2, "e")]
    assert pick(rel.two_ends(t, "x", "name", 1)) == [(0, "c"), (1, "")]
    picks = rel.exemplars(t, ["g"], ["x", "name"]).collect()
    assert sorted((r["g"] or 0, r["pick"], r["name"] or "") for r in picks if r["g"] == 1) == [(1, "max", "b"), (1, "median", "a"), (1, "min", "")]
    assert rel.in_largest_value(t.limit(0), ["g"], "x").count() == 0


def test_predicates_and_checks(t):
    assert t.filter(rel.in_set("name", ["a"])).count() == 1 and t.filter(~rel.in_set("name", ["a"])).count() == 5
    v = {r["rule"]: r["n_violations"] for r in rel.violations(t, {"g": F.col("g").isNotNull(), "x": F.col("x") < 4}).collect()}
    assert v == {"g": 2, "x": 1} and rel.violations(t.limit(0), {"g": F.col("g") > 0}).first()["n_violations"] == 0
    assert [r["n_missing"] for r in rel.glimpse(t).orderBy("position").collect()] == [2, 1, 2]
    for box in (None, (1, 2, 3), (5, 0, 4, 1), (-200, 0, 1, 1)):
        with pytest.raises(ValueError):
            rel.check_bbox(box)
    with pytest.raises(ValueError):
        rel.points_where(t, movement="flying")


def test_correlations_use_present_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (4.0, 9.0)], "a double, b double")
    r = {(x["x"], x["y"]): x["r"] for x in rel.correlations(df, ["a", "b"]).collect()}
    assert r["a", "b"] == pytest.approx(pd.Series([1, 2, 4]).corr(pd.Series([2, 4, 9]))) and r["a", "a"] == pytest.approx(1)


def test_samples_are_the_same_whatever_the_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert {r["k"] for r in rel.sample_rows(df, 20, "k").collect()} == {r["k"] for r in rel.sample_rows(df.repartition(13), 20, "k").collect()}


def test_taxonomy_is_three_valued(spark):
    df = spark.createDataFrame([("amenity", "bench"), ("amenity", "cafe"), ("military", None), (None, "bench"), ("amenity", None)], "class string, type string")
    got = [(r[0], r[1]) for r in df.select(X.matches(X.NOT_VISITABLE[0]), X.classify(X.CATEGORIES, "other")).collect()]
    assert got == [(True, "other"), (False, "restaurant"), (True, "other"), (None, "other"), (None, "other")]


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("subid,lat,junk,when\n1,43.5,zz,2024-01-02\nNA,bad,,\n")
    p = str(tmp_path / "x.csv")
    assert [tuple(r) for r in files.read_csv(spark, p, {"subid": "int", "lat": "double", "gone": "string"}).collect()] == [(1, 43.5, None), (None, None, None)]
    assert [tuple(r) for r in files.read_csv_types(spark, p, "id-c").collect()] == [(1, 43.5, "2024-01-02"), (None, None, None)]
    assert files.read_csv_inferred(spark, p).count() == 2
    with pytest.raises(ValueError):
        rel.type_string("ix", ["a", "b"])
    with pytest.raises(ValueError):
        rel.type_string("i", ["a", "b"])


def test_appends_match_by_name(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    files.append(a, str(tmp_path / "t"))
    files.append(spark.createDataFrame([("y", 2, 0)], "v string, k int, more int"), str(tmp_path / "t"), like=a.schema)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("k", "v").collect()) == [(1, "x"), (2, "y")]


def test_layers(spark, tmp_path):
    p = str(tmp_path / "a.gpkg")
    layers.write_geopackage(pd.DataFrame({"name": ["x", None], "geometry": ["POINT (1.5 -2.25)", None]}), p, "places")
    assert sorted((r["name"] or "", r["more"], r["geometry"]) for r in layers.read_layer(spark, p, "name string, more string").collect()) == [("", None, None), ("x", None, "POINT (1.5 -2.25)")]
    with pytest.raises(ValueError):
        layers.geopackage_rows(p, "nothing")
    q = str(tmp_path / "b.shp")
    layers.write_shapefile([({"id": 7}, [[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]])], q)
    assert [tuple(r) for r in layers.read_layer(spark, q, "id string").collect()] == [("7", "POLYGON ((0.0 0.0, 0.0 1.0, 1.0 1.0, 0.0 0.0))")]


def test_well_known_binary():
    point = struct.pack("<BI2d", 1, 1, 1.0, 2.0)
    assert layers.wkb_text(point)[0] == "POINT (1.0 2.0)"
    ring = struct.pack(">I6d", 3, 0, 0, 1, 0, 0, 0)
    poly = struct.pack(">BII", 0, 3, 1) + ring
    assert layers.wkb_text(struct.pack("<BII", 1, 6, 1) + poly)[0] == "MULTIPOLYGON (((0.0 0.0, 1.0 0.0, 0.0 0.0)))"
    high = struct.pack("<BI3d", 1, 1001, 1.0, 2.0, 3.0)
    assert layers.wkb_text(high) == ("POINT (1.0 2.0)", len(high))
    assert layers.geopackage_text(None) is None and layers.geopackage_text(b"xx") is None


def test_captured_errors(spark):
    assert catalog.safely(lambda: 1 / 0)[1] == "division by zero" and catalog.session_test(spark)[0]


@pytest.mark.parametrize("n_rows", [10, 5_000_000])
def test_lags_and_numbers(spark, n_rows):
    df = spark.createDataFrame([(1, 10, 1, "a", 1.0), (1, 10, 2, None, None), (1, 5, 3, "c", 2.0), (2, 1, 4, "d", 3.0)], "g long, us long, id long, name string not null, x double".replace(" not null", ""))
    got = {r["id"]: (r["prev_name"], r["prev_x"]) for r in with_previous(df, "g", ["us", "id"], ["name", "x"], n_rows=n_rows).collect()}
    assert got == {3: (None, None), 1: ("c", 2.0), 2: ("a", 1.0), 4: (None, None)}
    assert {r["id"]: r["row_id"] for r in numbered(df, ["g", "us", "id"], n_rows=n_rows).collect()} == {3: 1, 1: 2, 2: 3, 4: 4}


def test_sessions_at_the_edge_of_the_gap(spark):
    rows = [(1, 1, 0), (1, 2, 1800), (1, 3, 3601), (1, 4, 3601), (None, 5, 0), (2, 6, None)]
    df = spark.createDataFrame(rows, "subid int, processed_id long, s long").selectExpr("subid", "processed_id", "cast(timestamp_seconds(s) AS timestamp_ntz) AS time", "1 AS entity")
    assert sorted((r["start_id"], r["end_id"], r["duration_s"], r["n_events"]) for r in sessions(df).collect()) == [(1, 2, 1800.0, 2), (3, 4, 0.0, 2)]
    assert sessions(df.limit(0)).count() == 0
