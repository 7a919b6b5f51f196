"""Queries of sources, sinks, catalog and display rows.

Sinks write to a folder beside the checkpoints (see :func:`pathloom.session.work_folder`) and are read back.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import taxonomy as X
from ..operators import display as V
from ..operators import polygons as P
from ..operators import relational as rel
from ..operators.proximity import point_of, rings_of
from ..session import work_folder
from ..sources import catalog as C
from ..sources import files as S
from ..sources import layers
from ..streaming import activity
from . import spatial
from .registry import Registry, table

R = Registry()

_RAW = "SELECT point_id, subid, lat, lon, CAST(time AS VARCHAR) AS time FROM raw_gps"


def _folder(spark) -> str:
    return f"{work_folder(spark)}/{uuid.uuid4().hex}"


def _csv(spark, d, name, *columns) -> str:
    path = _folder(spark)
    S.write_csv(table(spark, d, name).select(*columns), path)
    return path


@R.query("s1_csv_declared_types", "SELECT point_id, subid, lat, lon, app_source FROM raw_gps")
def s1(spark, d):
    path = _csv(spark, d, "raw_gps", "point_id", "subid", "lat", "lon", "time", "app_source")
    return S.read_csv(spark, path, {"point_id": "bigint", "subid": "smallint", "lat": "double", "lon": "double", "app_source": "string"})


@R.query("s2_csv_inferred_types", "SELECT subid, lat, lon, utc FROM locations")
def s2(spark, d):
    return S.read_csv_inferred(spark, _csv(spark, d, "locations", "subid", "lat", "lon", "utc"))


@R.query("s3_csv_type_string", "SELECT CAST(subid AS VARCHAR) AS subid, lat, utc::DOUBLE AS utc FROM locations")
def s3(spark, d):
    return S.read_csv_types(spark, _csv(spark, d, "locations", "subid", "lat", "lon", "utc"), "cd-d")


def _single_rings(spark, d):
    return P.measures(table(spark, d, "osm_landuse"), ["osm_type", "osm_id"]).filter("n_rings = 1")


@R.query("s4_geopackage_layer", spatial.R.sql["j13_centroids"])
def s4(spark, d):
    # the regions are few at every scale; a layer is one file
    path = f"{_folder(spark)}.gpkg"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    t = _single_rings(spark, d).select("osm_type", "osm_id", F.format_string("POINT (%.12f %.12f)", "cx", "cy").alias("geometry"))
    layers.write_geopackage(t.toPandas(), path, "centres")
    x, y = point_of("geometry")
    return layers.read_layer(spark, path, "osm_type string, osm_id long", "centres").select("osm_type", "osm_id", F.round(x, 7).alias("cx"), F.round(y, 7).alias("cy"))


@R.query("s5_shapefile", spatial.R.sql["j12_areas"])
def s5(spark, d):
    path = f"{_folder(spark)}.shp"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    t = table(spark, d, "osm_landuse").join(_single_rings(spark, d), ["osm_type", "osm_id"], "left_semi").select("osm_type", "osm_id", "geom").distinct()
    layers.write_shapefile([({"osm_type": r["osm_type"], "osm_id": r["osm_id"]}, [x.tolist() for x in rings_of(r["geom"])]) for r in t.collect()], path)
    got = layers.read_layer(spark, path, "osm_type string, osm_id string").withColumn("osm_id", F.col("osm_id").cast("long"))
    return P.measures(got, ["osm_type", "osm_id"], "geometry").select("osm_type", "osm_id", F.round(F.col("area_mercator") / 1e6, 6).alias("sqkm"))


@R.query("s8_map_import", spatial.R.sql["j14_tag_rules"])
def s8(spark, d):
    path = _folder(spark)
    for name, features in zip(("poi", "landuse"), P.map_features(spatial.map_objects(spark, d)), strict=True):
        S.overwrite(features, f"{path}/{name}", sort=["class", "type"])
    read = lambda n: spark.read.parquet(f"{path}/{n}").groupBy(F.lit(n).alias("layer"), "class", "type").agg(F.count("*").alias("n"))
    return read("poi").unionByName(read("landuse"))


@R.query("s6_sql_text", "SELECT subid, count(*) AS n, min(lat) AS south FROM raw_gps WHERE lat > 0 GROUP BY subid")
def s6(spark, d):
    return spark.sql("SELECT subid, count(*) AS n, min(lat) AS south FROM {t} WHERE lat > 0 GROUP BY subid", t=table(spark, d, "raw_gps"))


@R.query("s7_sql_with_parameters", "SELECT osm_type, osm_id, type FROM osm_landuse WHERE type = 'retail' AND area_sqkm > 0.1 AND NOT isnan(area_sqkm)")
def s7(spark, d):
    view = f"landuse_{uuid.uuid4().hex}"
    table(spark, d, "osm_landuse").createOrReplaceTempView(view)
    out = spark.sql(f"SELECT osm_type, osm_id, type FROM {view} WHERE type = :kind AND area_sqkm > :least AND NOT isnan(area_sqkm)", args={"kind": "retail", "least": 0.1})
    spark.catalog.dropTempView(view)
    return out


@R.query("s9_box_extract", "SELECT DISTINCT osm_type, osm_id FROM osm_poi WHERE lon BETWEEN -92.889 AND -86.249 AND lat BETWEEN 42.492 AND 47.309")
def s9(spark, d):
    return rel.points_where(table(spark, d, "osm_poi"), bbox=(-92.889, 42.492, -86.249, 47.309)).select("osm_type", "osm_id").distinct()


@R.query("s11_inline_table", "SELECT * FROM (VALUES (1, 5, 50, 2), (2, 10, 50, 3), (3, 10, 100, 3)) v(param_id, dwell_threshold, eps_meters, min_pts)")
def s11(spark, d):
    return spark.createDataFrame([(1, 5, 50, 2), (2, 10, 50, 3), (3, 10, 100, 3)], "param_id int, dwell_threshold int, eps_meters int, min_pts int")


@R.query("kcsv_round_trip", "SELECT processed_id, subid, speed_mph, movement_state FROM processed_gps")
def kcsv(spark, d):
    path = _csv(spark, d, "processed_gps", "processed_id", "subid", "speed_mph", "movement_state")
    return S.read_csv(spark, path, {"processed_id": "bigint", "subid": "smallint", "speed_mph": "double", "movement_state": "string"})


@R.query("kapp_append", "SELECT subid, lat, lon FROM locations UNION ALL SELECT subid, lat, lon FROM raw_gps")
def kapp(spark, d):
    path, t = _folder(spark), table(spark, d, "locations").select("subid", "lat", "lon")
    S.append(t, path)
    S.append(table(spark, d, "raw_gps"), path, like=t.schema)
    return spark.read.parquet(path)


@R.query("kovr_overwrite", "SELECT osm_type, osm_id, type FROM osm_landuse")
def kovr(spark, d):
    path, t = _folder(spark), table(spark, d, "osm_landuse").select("osm_type", "osm_id", "type")
    S.overwrite(t.limit(5), path)
    S.overwrite(t, path, by=["osm_type"], sort=["osm_id"])
    return spark.read.parquet(path).select("osm_type", "osm_id", "type")


@R.query("ktmp_temporary_view", "SELECT subid, count(*) AS n FROM locations GROUP BY subid")
def ktmp(spark, d):
    view = f"temp_{uuid.uuid4().hex}"
    table(spark, d, "raw_gps").createOrReplaceTempView(view)
    table(spark, d, "locations").createOrReplaceTempView(view)
    out = spark.table(view).groupBy("subid").agg(F.count("*").alias("n"))
    spark.catalog.dropTempView(view)
    return out


@R.query("kobj_objects", "SELECT osm_type, osm_id, 'POINT (' || lon || ' ' || lat || ')' AS wkt FROM (SELECT DISTINCT osm_type, osm_id, lon, lat FROM osm_poi WHERE lon IS NOT NULL AND lat IS NOT NULL)")
def kobj(spark, d):
    t = table(spark, d, "osm_poi").filter("lon IS NOT NULL AND lat IS NOT NULL").select("osm_type", "osm_id", "lon", "lat").distinct()
    return S.snapshot(t.select("osm_type", "osm_id", F.concat(F.lit("POINT ("), F.col("lon"), F.lit(" "), F.col("lat"), F.lit(")")).alias("wkt")), _folder(spark))


@R.query("kmv_materialized_view", f"SELECT DISTINCT osm_id, osm_type, class, type, city FROM osm_poi WHERE NOT {X.matches_sql(X.NOT_VISITABLE[0])}")
def kmv(spark, d):
    t = table(spark, d, "osm_poi").filter(~X.matches(X.NOT_VISITABLE[0])).select("osm_id", "osm_type", "class", "type", "city").distinct()
    return S.snapshot(t, _folder(spark), sort=["class", "type"])


@R.query("ddl1_declared_schema", "SELECT point_id, subid, lat, lon, app_source FROM raw_gps")
def ddl1(spark, d):
    path = _folder(spark)
    name = f"t_{uuid.uuid4().hex}"
    C.create_table(spark, "default", name, C.SCHEMAS["raw_gps"], path)
    table(spark, d, "raw_gps").write.insertInto(f"default.{name}")
    out = spark.table(f"default.{name}").select("point_id", "subid", "lat", "lon", "app_source")
    spark.sql(f"DROP TABLE default.{name}")
    return out


@R.query("ddl2_added_column", "SELECT point_id, 'POINT(' || lon || ' ' || lat || ')' AS geom, lon, lat FROM raw_gps")
def ddl2(spark, d):
    return table(spark, d, "raw_gps").withColumn("geom", F.concat(F.lit("POINT("), F.col("lon"), F.lit(" "), F.col("lat"), F.lit(")"))).select("point_id", "geom", "lon", "lat")


@R.query("ddl3_layout_instead_of_indexes", "SELECT subid, count(*) AS n FROM raw_gps WHERE subid BETWEEN 100 AND 300 GROUP BY subid")
def ddl3(spark, d):
    path = _folder(spark)
    S.overwrite(table(spark, d, "raw_gps").repartitionByRange("subid", "time"), path, sort=["subid", "time"])
    return spark.read.parquet(path).filter(F.col("subid").between(100, 300)).groupBy("subid").agg(F.count("*").alias("n"))


@R.query("ddl4_catalog", "SELECT CAST(row_number() OVER () AS INTEGER) AS ordinal, column_name FROM (DESCRIBE SELECT * FROM raw_gps)")
def ddl4(spark, d):
    return C.columns_of(table(spark, d, "raw_gps")).select("ordinal", "column_name")


@R.query("ddl4_constraints", "SELECT * FROM (VALUES ('subid not null', (SELECT count(*) FROM raw_gps WHERE subid IS NULL)), ('time not null', (SELECT count(*) FROM raw_gps WHERE time IS NULL)), ('lat in range', (SELECT count(*) FROM raw_gps WHERE NOT lat BETWEEN -90 AND 90)), ('lon in range', (SELECT count(*) FROM raw_gps WHERE NOT lon BETWEEN -180 AND 180))) v(rule, n_violations)")
def ddl4_checks(spark, d):
    return rel.violations(table(spark, d, "raw_gps"), C.checks("raw_gps"))


@R.query("ddl5_session_with_captured_errors", "SELECT * FROM (VALUES ('session', true), ('missing table', false)) v(test, passed)")
def ddl5(spark, d):
    _, wrong = C.safely(lambda: spark.table("no_such_table").count())
    return spark.createDataFrame([("session", C.session_test(spark)[0]), ("missing table", wrong is None)], "test string, passed boolean")


# --- display rows


@R.query("v1_subject_points", "SELECT processed_id, lat, lon, CASE movement_state WHEN 'stationary' THEN 'blue' WHEN 'transition' THEN 'orange' ELSE 'grey' END AS colour FROM processed_gps WHERE subid = (SELECT min(subid) FROM processed_gps)")
def v1(spark, d):
    t = table(spark, d, "processed_gps")
    return V.subject_points(t, t.agg(F.min("subid")).first()[0]).select("processed_id", "lat", "lon", "colour")


@R.query("v1_centres", "SELECT subid, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*) AS n FROM processed_gps GROUP BY subid")
def v1_centres(spark, d):
    return V.centre(table(spark, d, "processed_gps"), ["subid"]).select("subid", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "n")


@R.query("v2_objects_by_class", "SELECT osm_type, osm_id, class, type FROM (SELECT DISTINCT osm_type, osm_id, class, type FROM osm_poi) WHERE class IN ('amenity', 'shop')")
def v2(spark, d):
    t = table(spark, d, "osm_poi").select("osm_type", "osm_id", "class", "type").distinct()
    return V.shown_objects(t, "osm_id", classes=["amenity", "shop"])


@R.query("v3_landuse_by_type", "SELECT DISTINCT osm_type, osm_id, type FROM osm_landuse WHERE type IN ('retail', 'commercial')")
def v3(spark, d):
    return V.shown_objects(table(spark, d, "osm_landuse").select("osm_type", "osm_id", "class", "type").distinct(), "osm_id", types=["retail", "commercial"]).select("osm_type", "osm_id", "type")


@R.query("v4_region_metric", "SELECT DISTINCT osm_type, osm_id, 'area_sqkm' AS metric, round(area_sqkm, 4) AS value FROM osm_landuse WHERE area_sqkm IS NOT NULL AND NOT isnan(area_sqkm)")
def v4(spark, d):
    metric = rel.one_of("area_sqkm", ["area_sqkm"], "metric")
    return table(spark, d, "osm_landuse").filter(F.col(metric).isNotNull() & ~F.isnan(metric)).select("osm_type", "osm_id", F.lit(metric).alias("metric"), F.round(metric, 4).alias("value")).distinct()


@R.query("v5_fix_popups", "SELECT processed_id, '<strong>GPS point</strong><br/><strong>Time:</strong> ' || strftime(time, '%Y-%m-%d %H:%M:%S') || '<br/><strong>Movement:</strong> ' || coalesce(movement_state, 'unknown') || '<br/>' || CASE WHEN dwell_time_seconds > 0 THEN '<strong>Dwell:</strong> ' || round(dwell_time_seconds / 60.0::DOUBLE, 1) || ' min<br/>' ELSE '' END || '<strong>Location:</strong> ' || printf('%.6f, %.6f', lat, lon) AS popup FROM processed_gps WHERE dwell_time_seconds < 60000000")
def v5(spark, d):
    return table(spark, d, "processed_gps").filter("dwell_time_seconds < 60000000").select("processed_id", V.fix_popup().alias("popup"))


@R.query("v5_addresses", "SELECT DISTINCT osm_type, osm_id, concat_ws(', ', nullif(street, ''), nullif(city, '')) AS address FROM osm_poi")
def v5_addresses(spark, d):
    return table(spark, d, "osm_poi").select("osm_type", "osm_id", V.address("street", "city").alias("address")).distinct()


@R.query("v5_object_popups")
def v5_objects(spark, d):
    a = table(spark, d, "osm_poi").select("osm_type", "osm_id", V.object_popup(X.classify(X.CATEGORIES)).alias("popup"))
    return a.unionByName(table(spark, d, "osm_landuse").select("osm_type", "osm_id", V.region_popup().alias("popup"))).distinct()


@R.query("v6_bounds", "SELECT subid, round(min(lon) - 0.01, 6) AS xmin, round(min(lat) - 0.01, 6) AS ymin, round(max(lon) + 0.01, 6) AS xmax, round(max(lat) + 0.01, 6) AS ymax FROM (SELECT subid, lat, lon FROM processed_gps UNION ALL SELECT subid, lat, lon FROM locations) GROUP BY subid")
def v6(spark, d):
    layers = [table(spark, d, n).select("subid", "lat", "lon") for n in ("processed_gps", "locations")]
    return rel.across(V.bounds(layers[0].unionByName(layers[1]), ["subid"]), "^[xy]m", lambda c: F.round(c, 6))


# --- streaming forms, run over the whole table as a stream that ends


@R.query("n1_stream_sessions", "WITH g AS (SELECT subid, processed_id, time, CASE WHEN time - lag(time) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS part FROM processed_gps WINDOW w AS (PARTITION BY subid ORDER BY time, processed_id)), s AS (SELECT *, sum(part) OVER (PARTITION BY subid ORDER BY time, processed_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT subid, epoch_us(min(time)) AS start_us, epoch_us(max(time)) AS end_us, count(*) AS n_fixes FROM s GROUP BY subid, session")
def n1(spark, d):
    fixes = activity.file_stream(spark, f"{d}/processed_gps.parquet").select("subid", F.col("time").cast("timestamp").alias("ts"))
    # a session window closes when its gap is full; exactly 30 minutes don't part two fixes
    path = activity.run_to_end(activity.session_counts(fixes, "1800.000001 seconds"), _folder(spark), "complete")
    return spark.read.parquet(path).select("subid", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_fixes")


@R.query("n2_stream_sliding_counts", "SELECT subid, epoch_us(e::TIMESTAMP - INTERVAL 2 DAY) AS start_us, count(*) AS n_fixes FROM (SELECT subid, unnest([CAST(time AS DATE) + 1, CAST(time AS DATE) + 2]) AS e FROM processed_gps) GROUP BY ALL")
def n2(spark, d):
    fixes = activity.file_stream(spark, f"{d}/processed_gps.parquet").select("subid", F.col("time").cast("timestamp").alias("ts"))
    path = activity.run_to_end(activity.sliding_counts(fixes, "2 days", "1 day"), _folder(spark), "complete")
    return spark.read.parquet(path).select("subid", F.unix_micros("start").alias("start_us"), "n_fixes")


@R.query("n3_stream_stays")
def n3(spark, d):
    fixes = activity.file_stream(spark, f"{d}/processed_gps.parquet").select("subid", "lat", "lon", F.col("time").cast("timestamp").alias("ts"))
    return spark.read.parquet(activity.run_to_end(activity.stays(fixes), _folder(spark), "append"))
