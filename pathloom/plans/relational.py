"""Queries of the table operators: filters, joins, aggregates, windows, order, sets, scalar functions, reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import taxonomy as X
from ..functions.geo import haversine_m, in_bbox
from ..operators import relational as rel
from ..operators.mobility import localise, valid_fixes
from ..operators.ordered import numbered, with_previous
from ..operators.sessions import collapse, micros
from ..session import lookup_join
from .registry import Registry, sql_haversine, table

R = Registry()
BOX = (-90.5, 42.6, -88.0, 44.0)
IN_BOX = "lon BETWEEN -90.5 AND -88.0 AND lat BETWEEN 42.6 AND 44.0"


def gps(spark, d):
    return table(spark, d, "processed_gps")


def raw(spark, d):
    return table(spark, d, "raw_gps")


def poi(spark, d):
    return table(spark, d, "osm_poi").dropDuplicates(["osm_type", "osm_id"])


POI = "(SELECT DISTINCT osm_type, osm_id, class, type FROM osm_poi)"


# --- projections and filters


@R.query("f1_valid_fixes", "SELECT point_id, subid, lat, lon, time FROM raw_gps WHERE subid IS NOT NULL AND time IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")
def f1(spark, d):
    return valid_fixes(raw(spark, d)).select("point_id", "subid", "lat", "lon", "time")


@R.query("f2_select_rename_drop_reorder", "SELECT movement_state AS state, processed_id, subid, raw_point_id, lat AS latitude, lon AS longitude, dwell_time_seconds FROM processed_gps")
def f2(spark, d):
    t = gps(spark, d).drop("time", "time_local", "cluster_id", "speed_mph", "dist_miles", "is_stationary").withColumnsRenamed({"movement_state": "state", "lat": "latitude", "lon": "longitude"})
    return t.select("state", *(c for c in t.columns if c != "state"))


@R.query("f3_derived_columns", "SELECT processed_id, round(speed_mph * 1.609344, 3) AS speed_kmh, round(dist_miles * 5280, 2) AS dist_feet, hour(time) AS hour_utc, lat >= 44 AS north FROM processed_gps")
def f3(spark, d):
    return gps(spark, d).withColumns({"speed_kmh": F.round(F.col("speed_mph") * 1.609344, 3), "dist_feet": F.round(F.col("dist_miles") * 5280, 2), "hour_utc": F.hour("time"), "north": F.col("lat") >= 44}).select("processed_id", "speed_kmh", "dist_feet", "hour_utc", "north")


@R.query("f4_across_columns", "SELECT processed_id, coalesce(round(speed_mph, 0), 0) + 0 AS speed_mph, coalesce(round(dist_miles, 0), 0) + 0 AS dist_miles FROM processed_gps")
def f4(spark, d):
    return rel.across(gps(spark, d).select("processed_id", "speed_mph", "dist_miles"), "_(mph|miles)$", lambda c: F.coalesce(F.round(c, 0), F.lit(0.0)))


@R.query("f5_membership", "SELECT point_id, coalesce(app_source IN ('loc-core', 'pathlog'), false) AS known_app FROM raw_gps")
def f5(spark, d):
    return raw(spark, d).select("point_id", rel.in_set("app_source", ["loc-core", "pathlog"]).alias("known_app"))


@R.query("f6_semi_filter", "SELECT subid, utc, type FROM locations WHERE subid IN (SELECT subid FROM study_dates_gps WHERE study_end IS NOT NULL)")
def f6(spark, d):
    return table(spark, d, "locations").join(table(spark, d, "study_dates_gps").filter("study_end IS NOT NULL"), "subid", "left_semi").select("subid", "utc", "type")


@R.query("f7_between_check", "SELECT * FROM (VALUES ('lat', (SELECT count(*) FROM processed_gps WHERE NOT lat BETWEEN -90 AND 90)), ('lon', (SELECT count(*) FROM processed_gps WHERE NOT lon BETWEEN -180 AND 180)), ('speed', (SELECT count(*) FROM processed_gps WHERE NOT speed_mph BETWEEN 0 AND 100))) v(rule, n_violations)")
def f7(spark, d):
    return rel.violations(gps(spark, d), {"lat": F.col("lat").between(-90, 90), "lon": F.col("lon").between(-180, 180), "speed": F.col("speed_mph").between(0, 100)})


@R.query("f8_composed_predicates", f"SELECT processed_id, subid, lat, lon FROM processed_gps WHERE subid = (SELECT min(subid) FROM processed_gps) AND movement_state = 'stationary' UNION ALL SELECT processed_id, subid, lat, lon FROM processed_gps WHERE movement_state = 'transition' AND {IN_BOX}")
def f8(spark, d):
    t = gps(spark, d)
    lowest = t.agg(F.min("subid")).first()[0]
    return rel.points_where(t, subid=lowest, movement="stationary").unionByName(rel.points_where(t, movement="transition", bbox=BOX)).select("processed_id", "subid", "lat", "lon")


@R.query("f9_visitable", f"SELECT osm_type, osm_id, class, type FROM {POI} WHERE NOT {X.matches_sql(X.NOT_VISITABLE[0])}")
def f9(spark, d):
    return poi(spark, d).filter(~X.matches(X.NOT_VISITABLE[0])).select("osm_type", "osm_id", "class", "type")


@R.query("f10_text_predicate", "SELECT DISTINCT subid, utc FROM locations WHERE contains(lower(type), 'ho') OR regexp_matches(type, '^(bar|gym)$')")
def f10(spark, d):
    return table(spark, d, "locations").filter(F.lower("type").contains("ho") | F.col("type").rlike("^(bar|gym)$")).select("subid", "utc").distinct()


@R.query("f11_group_filter", "SELECT subid, utc, lat, lon FROM (SELECT *, count(*) OVER (PARTITION BY subid) AS n, max(utc) OVER (PARTITION BY subid) AS top FROM locations) WHERE n >= 2 AND utc = top")
def f11(spark, d):
    t = table(spark, d, "locations")
    groups = t.groupBy("subid").agg(F.count("*").alias("n"), F.max("utc").alias("top"))
    return rel.attach(t, groups, ["subid"]).filter("n >= 2 AND utc = top").select("subid", "utc", "lat", "lon")


@R.query("f12_post_aggregate_filter", "SELECT subid, count(*) AS n_fixes, count(DISTINCT CAST(time AS DATE)) AS n_days FROM processed_gps GROUP BY subid HAVING count(*) >= 100 AND count(DISTINCT CAST(time AS DATE)) >= 2")
def f12(spark, d):
    return gps(spark, d).groupBy("subid").agg(F.count("*").alias("n_fixes"), F.countDistinct(F.to_date("time")).alias("n_days")).filter("n_fixes >= 100 AND n_days >= 2")


@R.query("f13_argument_checks", "SELECT * FROM (VALUES ('box', true), ('box of three', false), ('box upside down', false), ('box off the globe', false), ('movement', true), ('movement flying', false)) v(argument, accepted)")
def f13(spark, d):
    def ok(f, *a):
        try:
            f(*a)
            return True
        except ValueError:
            return False

    moves = ["stationary", "transition"]
    rows = [("box", ok(rel.check_bbox, BOX)), ("box of three", ok(rel.check_bbox, BOX[:3])), ("box upside down", ok(rel.check_bbox, (-88, 44, -90, 42))), ("box off the globe", ok(rel.check_bbox, (-190, 42, -88, 44))), ("movement", ok(rel.one_of, "transition", moves)), ("movement flying", ok(rel.one_of, "flying", moves))]
    return spark.createDataFrame(rows, "argument string, accepted boolean")


@R.query("f14_poi_categories", f"SELECT {X.classify_sql(X.CATEGORIES, 'other')} AS poi_category, count(*) AS n_poi FROM {POI} GROUP BY 1")
def f14(spark, d):
    return poi(spark, d).groupBy(X.classify(X.CATEGORIES, "other").alias("poi_category")).agg(F.count("*").alias("n_poi"))


@R.query("f15_visit_categories", f"SELECT osm_type, osm_id, {X.classify_sql(X.VISITS)} AS category, CASE WHEN {X.classify_sql(X.VISITS)} IN ('alcohol_on_premise', 'alcohol_off_premise') THEN 'yes' ELSE 'no' END AS venue FROM {POI}")
def f15(spark, d):
    t = poi(spark, d).withColumn("category", X.classify(X.VISITS))
    return t.select("osm_type", "osm_id", "category", F.when(rel.in_set("category", ["alcohol_on_premise", "alcohol_off_premise"]), "yes").otherwise("no").alias("venue"))


@R.query("f16_premises_two_ways", f"SELECT osm_type, osm_id, {X.classify_sql(X.PREMISE_PINGS)} AS by_pings, {X.classify_sql(X.PREMISE_GRID, 'other')} AS by_grid FROM {POI}")
def f16(spark, d):
    return poi(spark, d).select("osm_type", "osm_id", X.classify(X.PREMISE_PINGS).alias("by_pings"), X.classify(X.PREMISE_GRID, "other").alias("by_grid"))


@R.query("f17_bands", "SELECT band, sort_key, count(*) AS n FROM (SELECT CASE WHEN dist_miles IS NULL THEN 'none' WHEN dist_miles * 1609.344 <= 50 THEN 'at most 50 m' WHEN dist_miles * 1609.344 <= 100 THEN 'at most 100 m' WHEN dist_miles * 1609.344 <= 500 THEN 'at most 500 m' ELSE 'over 500 m' END AS band, CASE WHEN dist_miles IS NULL THEN 5 WHEN dist_miles * 1609.344 <= 50 THEN 1 WHEN dist_miles * 1609.344 <= 100 THEN 2 WHEN dist_miles * 1609.344 <= 500 THEN 3 ELSE 4 END AS sort_key FROM processed_gps) GROUP BY ALL")
def f17(spark, d):
    m, pair = F.col("dist_miles") * 1609.344, lambda b, k: F.struct(F.lit(b).alias("band"), F.lit(k).alias("sort_key"))
    band = F.when(m.isNull(), pair("none", 5)).when(m <= 50, pair("at most 50 m", 1)).when(m <= 100, pair("at most 100 m", 2)).when(m <= 500, pair("at most 500 m", 3)).otherwise(pair("over 500 m", 4))
    return gps(spark, d).select(band.alias("b")).groupBy("b.band", "b.sort_key").agg(F.count("*").alias("n"))


@R.query("f18_difference_category", "SELECT subid, CASE WHEN a - b > 2 THEN 'more' WHEN a - b < -2 THEN 'fewer' ELSE 'about as many' END AS category FROM (SELECT subid, count(DISTINCT lower(type)) AS a, count(*) FILTER (WHERE type IS NULL) AS b FROM locations GROUP BY subid)")
def f18(spark, d):
    n = table(spark, d, "locations").groupBy("subid").agg((F.countDistinct(F.lower("type")) - F.count_if(F.col("type").isNull())).alias("diff"))
    return n.select("subid", F.when(F.col("diff") > 2, "more").when(F.col("diff") < -2, "fewer").otherwise("about as many").alias("category"))


@R.query("f19_glimpse", "SELECT * FROM (VALUES (1, 'subid', (SELECT count(*) FROM locations), (SELECT count(*) - count(subid) FROM locations)), (2, 'lat', (SELECT count(*) FROM locations), (SELECT count(*) - count(lat) FROM locations)), (3, 'lon', (SELECT count(*) FROM locations), (SELECT count(*) - count(lon) FROM locations)), (4, 'type', (SELECT count(*) FROM locations), (SELECT count(*) - count(type) FROM locations)), (5, 'utc', (SELECT count(*) FROM locations), (SELECT count(*) - count(utc) FROM locations))) v(position, column_name, n_rows, n_missing)")
def f19(spark, d):
    return rel.glimpse(table(spark, d, "locations"))


@R.query("f20_injected_variable", "SELECT processed_id, subid FROM processed_gps WHERE subid = (SELECT max(subid) FROM study_dates_gps)")
def f20(spark, d):
    subid = table(spark, d, "study_dates_gps").agg(F.max("subid")).first()[0]
    return gps(spark, d).filter(F.col("subid") == F.lit(subid)).select("processed_id", "subid")


# --- joins


@R.query("c1_inner_join", "SELECT p.processed_id, r.app_source FROM processed_gps p JOIN raw_gps r ON p.raw_point_id = r.point_id")
def c1(spark, d):
    return gps(spark, d).join(raw(spark, d), F.col("raw_point_id") == F.col("point_id")).select("processed_id", "app_source")


@R.query("c2_inner_join_many_keys", "SELECT p.processed_id, r.point_id FROM processed_gps p JOIN raw_gps r ON p.subid = r.subid AND p.time = r.time AND p.lat = r.lat AND p.lon = r.lon")
def c2(spark, d):
    return gps(spark, d).join(raw(spark, d), ["subid", "time", "lat", "lon"]).select("processed_id", "point_id")


@R.query("c3_join_of_two_subqueries", "WITH a AS (SELECT subid, count(*) AS n_raw FROM raw_gps GROUP BY subid), b AS (SELECT subid, count(*) AS n_processed FROM processed_gps GROUP BY subid) SELECT subid, n_raw, n_processed FROM a JOIN b USING (subid)")
def c3(spark, d):
    a = raw(spark, d).groupBy("subid").agg(F.count("*").alias("n_raw"))
    return a.join(gps(spark, d).groupBy("subid").agg(F.count("*").alias("n_processed")), "subid")


@R.query("c4_left_joins", "SELECT r.point_id, p.processed_id, CAST(s.study_start AS VARCHAR) AS study_start FROM raw_gps r LEFT JOIN processed_gps p ON r.point_id = p.raw_point_id LEFT JOIN study_dates_gps s ON r.subid = s.subid")
def c4(spark, d):
    p = gps(spark, d).select("processed_id", F.col("raw_point_id").alias("point_id"))
    s = table(spark, d, "study_dates_gps").select("subid", F.col("study_start").cast("string"))
    return lookup_join(raw(spark, d).select("point_id", "subid").join(p, "point_id", "left"), s, ["subid"], spread="point_id", how="left").select("point_id", "processed_id", "study_start")


@R.query("c5_left_join_suffixes", 'SELECT r.point_id, r.lat AS "lat.x", r.lon AS "lon.x", p.lat AS "lat.y", p.lon AS "lon.y" FROM raw_gps r LEFT JOIN processed_gps p ON r.point_id = p.raw_point_id')
def c5(spark, d):
    x, y = raw(spark, d).alias("x"), gps(spark, d).alias("y")
    return x.join(y, F.expr("x.point_id = y.raw_point_id"), "left").selectExpr("x.point_id", "x.lat AS `lat.x`", "x.lon AS `lon.x`", "y.lat AS `lat.y`", "y.lon AS `lon.y`")


@R.query("c6_left_join_one_to_many", "SELECT s.subid, CAST(s.study_start AS VARCHAR) AS study_start, l.type, l.utc FROM study_dates_gps s LEFT JOIN locations l USING (subid)")
def c6(spark, d):
    one = table(spark, d, "study_dates_gps")
    assert not one.groupBy("subid").count().filter("count > 1").limit(1).count(), "left side must be unique"
    return one.join(table(spark, d, "locations"), "subid", "left").select("subid", F.col("study_start").cast("string"), "type", "utc")


@R.query("c7_band_join", "WITH n AS (SELECT subid, CAST(time AS DATE) AS day, count(*) AS n FROM processed_gps GROUP BY ALL) SELECT a.subid, CAST(a.day AS VARCHAR) AS day, CAST(sum(b.n) AS BIGINT) AS n_fixes, count(*) AS n_days FROM n a JOIN n b ON a.subid = b.subid AND b.day BETWEEN a.day - 6 AND a.day GROUP BY a.subid, a.day")
def c7(spark, d):
    # pooled per day first; each pool goes to the seven days that look back on it, an equi-join instead of a range
    n = gps(spark, d).groupBy("subid", F.to_date("time").alias("day")).agg(F.count("*").alias("n"))
    seen = n.select("subid", F.explode(F.sequence("day", F.date_add("day", 6))).alias("day"), "n")
    return seen.join(n.select("subid", "day"), ["subid", "day"]).groupBy("subid", F.col("day").cast("string").alias("day")).agg(F.sum("n").alias("n_fixes"), F.count("*").alias("n_days"))


PARAMS = [(5, 50), (10, 50), (10, 100)]


@R.query("c8_semi_join_on_parameters", "SELECT * FROM (SELECT d.dwell, e.eps FROM (VALUES (2), (5), (10), (15)) d(dwell), (VALUES (25), (50), (75), (100)) e(eps)) WHERE (dwell, eps) IN (VALUES (5, 50), (10, 50), (10, 100))")
def c8(spark, d):
    return _grid(spark).join(spark.createDataFrame(PARAMS, "dwell int, eps int"), ["dwell", "eps"], "left_semi")


def _grid(spark):
    return spark.createDataFrame([(x,) for x in (2, 5, 10, 15)], "dwell int").crossJoin(spark.createDataFrame([(x,) for x in (25, 50, 75, 100)], "eps int"))


@R.query("c9_cross_product_of_parameters", "SELECT d.dwell, e.eps FROM (VALUES (2), (5), (10), (15)) d(dwell), (VALUES (25), (50), (75), (100)) e(eps)")
def c9(spark, d):
    return _grid(spark)


@R.query("c10_cross_join_with_one_row", "WITH b AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM raw_gps WHERE lat BETWEEN 42 AND 47 AND lon BETWEEN -93 AND -86) SELECT DISTINCT osm_type, osm_id FROM osm_poi, b WHERE lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1")
def c10(spark, d):
    box = raw(spark, d).filter(in_bbox("lon", "lat", -93, 42, -86, 47)).agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    return table(spark, d, "osm_poi").crossJoin(F.broadcast(box)).filter("lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1").select("osm_type", "osm_id").distinct()


@R.query("c14_lookup_of_another_tables_rows", "SELECT l.subid, l.utc, l.lat, l.lon, coalesce(n, 0) AS n_fixes_that_day FROM (SELECT DISTINCT subid, utc, lat, lon FROM locations) l LEFT JOIN (SELECT subid, CAST(time AS DATE) AS day, count(*) AS n FROM processed_gps GROUP BY ALL) g ON l.subid = g.subid AND CAST(make_timestamp(l.utc * 1000000) AS DATE) = g.day")
def c14(spark, d):
    per_day = gps(spark, d).groupBy("subid", F.to_date("time").alias("day")).agg(F.count("*").alias("n"))
    t = table(spark, d, "locations").select("subid", "utc", "lat", "lon").distinct().withColumn("day", F.expr("date_add(DATE'1970-01-01', cast(floor(utc / 86400) AS int))"))
    return t.join(per_day, ["subid", "day"], "left").select("subid", "utc", "lat", "lon", F.coalesce("n", F.lit(0)).alias("n_fixes_that_day"))


@R.query("c15_links_inside_a_group", f"WITH l AS (SELECT subid, lat, lon, count(*) AS n FROM locations GROUP BY ALL) SELECT a.subid, a.lat, a.lon, CAST(sum(b.n) AS BIGINT) - 1 AS n_within_50_m FROM l a JOIN l b ON a.subid = b.subid WHERE {sql_haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 50 GROUP BY ALL")
def c15(spark, d):
    # equal positions are pooled, and only positions in neighbouring cells are compared; links are counted, not listed
    size = 0.0008  # over 50 m of latitude, and of longitude up to 55 degrees
    p = table(spark, d, "locations").groupBy("subid", "lat", "lon").agg(F.count("*").alias("n")).withColumns({"cx": F.floor(F.col("lon") / size), "cy": F.floor(F.col("lat") / size)})
    near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    left = p.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).select("subid", "lat", "lon", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    right = p.select("subid", "cx", "cy", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "n")
    return left.join(right, ["subid", "cx", "cy"]).filter(haversine_m("lon", "lat", "lon2", "lat2") <= 50).groupBy("subid", "lat", "lon").agg((F.sum("n") - 1).alias("n_within_50_m"))


# --- aggregates


@R.query("a1_counts_by_keys", f"SELECT class, type, count(*) AS n FROM {POI} GROUP BY class, type ORDER BY n DESC, class, type")
def a1(spark, d):
    return poi(spark, d).groupBy("class", "type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class", "type")


@R.query("a2_missing_counts", "SELECT count(*) AS n_rows, count(speed_mph) AS n_speed, count(*) - count(speed_mph) AS missing_speed, count(*) - count(movement_state) AS missing_state FROM processed_gps")
def a2(spark, d):
    return gps(spark, d).agg(F.count("*").alias("n_rows"), F.count("speed_mph").alias("n_speed"), (F.count("*") - F.count("speed_mph")).alias("missing_speed"), (F.count("*") - F.count("movement_state")).alias("missing_state"))


@R.query("a3_distinct_counts", "SELECT count(DISTINCT subid) AS subjects, count(DISTINCT movement_state) AS spellings, count(DISTINCT CAST(subid AS VARCHAR) || '/' || CAST(CAST(time AS DATE) AS VARCHAR)) AS subject_days FROM processed_gps")
def a3(spark, d):
    return gps(spark, d).agg(F.countDistinct("subid").alias("subjects"), F.countDistinct("movement_state").alias("spellings"), F.countDistinct(F.concat_ws("/", F.col("subid"), F.to_date("time"))).alias("subject_days"))


@R.query("a4_conditional_distinct", "SELECT subid, count(DISTINCT CASE WHEN type IS NOT NULL AND lower(type) <> 'other' THEN lower(type) END) AS n_kinds FROM locations GROUP BY subid")
def a4(spark, d):
    kind = F.lower("type")
    return table(spark, d, "locations").groupBy("subid").agg(F.countDistinct(F.when(kind != "other", kind)).alias("n_kinds"))


@R.query("a5_filtered_counts", "SELECT subid, count(*) FILTER (WHERE is_stationary) AS n_still, count(*) FILTER (WHERE NOT is_stationary) AS n_moving, count(*) FILTER (WHERE speed_mph > 60) AS n_fast FROM processed_gps GROUP BY subid")
def a5(spark, d):
    return gps(spark, d).groupBy("subid").agg(F.count_if("is_stationary").alias("n_still"), F.count_if(~F.col("is_stationary")).alias("n_moving"), F.count_if(F.col("speed_mph") > 60).alias("n_fast"))


@R.query("a6_conditional_sums", "SELECT subid, count(CASE WHEN speed_mph <= 4 THEN 1 END) AS n_slow, CAST(coalesce(sum(CASE WHEN speed_mph > 4 THEN 1 END), 0) AS BIGINT) AS n_other FROM processed_gps GROUP BY subid")
def a6(spark, d):
    v = F.col("speed_mph")
    return gps(spark, d).groupBy("subid").agg(F.count(F.when(v <= 4, 1)).alias("n_slow"), F.coalesce(F.sum((v > 4).cast("long")), F.lit(0)).alias("n_other"))


@R.query("a7_min_max_sum_avg", "SELECT subid, min(lat) AS min_lat, max(lat) AS max_lat, CAST(sum(dwell_time_seconds) AS BIGINT) AS seconds, round(avg(speed_mph), 4) AS avg_speed FROM processed_gps GROUP BY subid")
def a7(spark, d):
    return gps(spark, d).groupBy("subid").agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.sum("dwell_time_seconds").alias("seconds"), F.round(F.avg("speed_mph"), 4).alias("avg_speed"))


@R.query("a8_median", "SELECT subid, round(median(speed_mph), 6) AS median_speed, round(median(dwell_time_seconds), 3) AS median_gap FROM processed_gps GROUP BY subid")
def a8(spark, d):
    return gps(spark, d).groupBy("subid").agg(F.round(F.median("speed_mph"), 6).alias("median_speed"), F.round(F.median("dwell_time_seconds"), 3).alias("median_gap"))


@R.query("a9_percentiles", "SELECT round(quantile_cont(dwell_time_seconds, 0.05), 4) AS p05, round(quantile_cont(dwell_time_seconds, 0.25), 4) AS p25, round(quantile_cont(dwell_time_seconds, 0.75), 4) AS p75, round(quantile_cont(dwell_time_seconds, 0.99), 4) AS p99 FROM processed_gps")
def a9(spark, d):
    return gps(spark, d).agg(*(F.round(F.percentile("dwell_time_seconds", F.lit(q)), 4).alias(n) for n, q in (("p05", 0.05), ("p25", 0.25), ("p75", 0.75), ("p99", 0.99))))


@R.query("a10_sample_deviation", "SELECT lower(type) AS kind, round(stddev_samp(lat), 6) AS sd_lat, round(stddev_samp(lon), 6) AS sd_lon FROM locations GROUP BY 1")
def a10(spark, d):
    return table(spark, d, "locations").groupBy(F.lower("type").alias("kind")).agg(F.round(F.stddev_samp("lat"), 6).alias("sd_lat"), F.round(F.stddev_samp("lon"), 6).alias("sd_lon"))


_CORR = "SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS r FROM processed_gps"


@R.query("a11_correlation_matrix", " UNION ALL ".join(_CORR.format(x=x, y=y) for x in ("lat", "lon", "dwell_time_seconds") for y in ("lat", "lon", "dwell_time_seconds")))
def a11(spark, d):
    return rel.correlations(gps(spark, d), ["lat", "lon", "dwell_time_seconds"]).withColumn("r", F.round("r", 6))


@R.query("a12_nested_aggregate", "SELECT count(*) AS n_subjects, round(avg(n), 2) AS avg_fixes, min(n) AS fewest, max(n) AS most FROM (SELECT subid, count(*) AS n FROM processed_gps GROUP BY subid)")
def a12(spark, d):
    return gps(spark, d).groupBy("subid").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_subjects"), F.round(F.avg("n"), 2).alias("avg_fixes"), F.min("n").alias("fewest"), F.max("n").alias("most"))


@R.query("a13_share_of_total", "SELECT movement_state, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM processed_gps), 4) AS pct FROM processed_gps GROUP BY movement_state")
def a13(spark, d):
    return rel.shares(gps(spark, d).groupBy("movement_state").agg(F.count("*").alias("n"))).withColumn("pct", F.round("pct", 4))


@R.query("a14_first_in_group", "SELECT subid, arg_min(type, (utc, type)) AS first_type, min(utc) AS first_utc FROM (SELECT subid, utc, type FROM locations WHERE type IS NOT NULL) GROUP BY subid")
def a14(spark, d):
    t = table(spark, d, "locations").filter("type IS NOT NULL")
    return t.groupBy("subid").agg(F.min(F.struct("utc", "type")).alias("f")).select("subid", F.col("f.type").alias("first_type"), F.col("f.utc").alias("first_utc"))


@R.query("a15_list_arithmetic", "SELECT subid, round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT subid, count(*) / sum(count(*)) OVER (PARTITION BY subid) AS p FROM locations WHERE type IS NOT NULL GROUP BY subid, lower(type)) GROUP BY subid")
def a15(spark, d):
    # the collected list holds one number a kind of place, not the rows
    kinds = table(spark, d, "locations").filter("type IS NOT NULL").groupBy("subid", F.lower("type").alias("kind")).agg(F.count("*").alias("n"))
    lists = kinds.groupBy("subid").agg(F.array_sort(F.collect_list("n")).alias("ns"))
    total = F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x)
    p = F.transform("ns", lambda x: x / total)
    return lists.select("subid", F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.log(x)), 6).alias("entropy"))


@R.query("a16_distinct_strings", "SELECT subid, string_agg(kind, ', ' ORDER BY kind) AS kinds FROM (SELECT DISTINCT subid, lower(type) AS kind FROM locations WHERE type IS NOT NULL) GROUP BY subid")
def a16(spark, d):
    return table(spark, d, "locations").groupBy("subid").agg(F.array_join(F.array_sort(F.collect_set(F.lower("type"))), ", ").alias("kinds")).filter("kinds <> ''")


@R.query("a17_conditional_min", "SELECT subid, CAST(min(CASE WHEN lower(type) = 'clinic' THEN utc END) AS DOUBLE) AS first_clinic FROM locations GROUP BY subid")
def a17(spark, d):
    return table(spark, d, "locations").groupBy("subid").agg(F.min(F.when(F.lower("type") == "clinic", F.col("utc"))).cast("double").alias("first_clinic"))


@R.query("a18_proportion", "SELECT subid, round(avg(CAST(speed_mph > 0 AS DOUBLE)), 6) AS moving_share FROM processed_gps GROUP BY subid")
def a18(spark, d):
    return gps(spark, d).groupBy("subid").agg(F.round(F.avg((F.col("speed_mph") > 0).cast("double")), 6).alias("moving_share"))


@R.query("a19_extent", "SELECT osm_type, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM osm_poi GROUP BY osm_type")
def a19(spark, d):
    return table(spark, d, "osm_poi").groupBy("osm_type").agg(F.min("lon").alias("xmin"), F.min("lat").alias("ymin"), F.max("lon").alias("xmax"), F.max("lat").alias("ymax"))


@R.query("a20_six_numbers", 'SELECT subid, round(min(speed_mph), 4) AS "min", round(quantile_cont(speed_mph, 0.25), 4) AS q25, round(median(speed_mph), 4) AS median, round(avg(speed_mph), 4) AS mean, round(quantile_cont(speed_mph, 0.75), 4) AS q75, round(max(speed_mph), 4) AS "max" FROM processed_gps GROUP BY subid')
def a20(spark, d):
    return rel.across(rel.six_numbers(gps(spark, d), "speed_mph", ["subid"]), "^(?!subid)", lambda c: F.round(c, 4))


@R.query("a21_contingency", "SELECT coalesce(CAST(is_stationary AS VARCHAR), 'none') AS is_stationary, coalesce(CAST(speed_mph <= 4 AS VARCHAR), 'none') AS slow, count(*) AS n FROM processed_gps GROUP BY ALL")
def a21(spark, d):
    return gps(spark, d).groupBy(*(F.coalesce(c.cast("string"), F.lit("none")).alias(n) for c, n in ((F.col("is_stationary"), "is_stationary"), (F.col("speed_mph") <= 4, "slow")))).agg(F.count("*").alias("n"))


# --- windows: those over a subject's fixes are ordered scans, so a heavy subject isn't one task's


def _ordered(spark, d):
    return gps(spark, d).select(F.col("subid").cast("long").alias("subid"), micros("time").alias("us"), "processed_id", "speed_mph")


@R.query("w1_first_row_of_group", "SELECT processed_id, subid FROM (SELECT *, row_number() OVER (PARTITION BY subid ORDER BY time, processed_id) AS r FROM processed_gps) WHERE r = 1")
def w1(spark, d):
    first = gps(spark, d).groupBy("subid").agg(F.min(F.struct("time", "processed_id")).alias("f"))
    return first.select(F.col("f.processed_id").alias("processed_id"), "subid")


@R.query("w2_lag", "SELECT processed_id, lag(speed_mph) OVER w AS prev_speed, (epoch_us(time) - epoch_us(lag(time) OVER w)) // 1000000 AS gap_s FROM processed_gps WINDOW w AS (PARTITION BY subid ORDER BY time, processed_id)")
def w2(spark, d):
    t = _ordered(spark, d)
    lag = with_previous(t, "subid", ["us", "processed_id"], ["speed_mph", "us"], n_rows=t.count())
    return lag.select("processed_id", F.col("prev_speed_mph").alias("prev_speed"), F.expr("(us - prev_us) div 1000000").alias("gap_s"))


@R.query("w3_cumulative_flags", "WITH g AS (SELECT *, CASE WHEN time - lag(time) OVER w <= INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS new FROM processed_gps WINDOW w AS (PARTITION BY subid ORDER BY time, processed_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY subid ORDER BY time, processed_id ROWS UNBOUNDED PRECEDING) AS island FROM g) SELECT subid, island::BIGINT AS island, count(*) AS n, arg_min(processed_id, (time, processed_id)) AS first_id FROM s GROUP BY subid, island")
def w3(spark, d):
    t = _ordered(spark, d)
    runs = collapse(t, "subid", "us", "processed_id", silence_us=3_600_000_000, n_rows=t.count())
    # islands are few rows a subject; they are numbered by a window over them
    return runs.select(F.col("subid").cast("smallint").alias("subid"), F.row_number().over(Window.partitionBy("subid").orderBy("start_us", "start_id")).cast("long").alias("island"), "n", F.col("start_id").alias("first_id"))


@R.query("w4_group_value_on_rows", "SELECT subid, utc, lat, lon, min(utc) OVER (PARTITION BY subid) AS first_utc, count(*) OVER (PARTITION BY subid) AS n_reports FROM locations")
def w4(spark, d):
    t = table(spark, d, "locations").select("subid", "utc", "lat", "lon")
    return rel.attach(t, t.groupBy("subid").agg(F.min("utc").alias("first_utc"), F.count("*").alias("n_reports")), ["subid"])


@R.query("w5_surrogate_id", "SELECT point_id, row_number() OVER (ORDER BY point_id) AS row_id FROM raw_gps")
def w5(spark, d):
    t = raw(spark, d).select("point_id")
    return numbered(t, ["point_id"], n_rows=t.count())


@R.query("w6_ordinal_in_group", "SELECT subid, utc, lat, lon, n AS fu_number FROM (SELECT *, row_number() OVER (PARTITION BY subid ORDER BY utc, lat, lon) AS n FROM (SELECT DISTINCT subid, utc, lat, lon FROM locations)) WHERE n <= 3")
def w6(spark, d):
    t = table(spark, d, "locations").select("subid", "utc", "lat", "lon").distinct()
    return t.withColumn("fu_number", F.row_number().over(Window.partitionBy("subid").orderBy("utc", "lat", "lon"))).filter("fu_number <= 3").withColumn("fu_number", F.col("fu_number").cast("long"))


@R.query("w7_cumulative_percent", "WITH c AS (SELECT hour(time) AS hour, count(*) AS n FROM processed_gps GROUP BY 1) SELECT hour, n, round(100.0::DOUBLE * n / sum(n) OVER (), 4) AS pct, round(100.0::DOUBLE * sum(n) OVER (ORDER BY hour) / sum(n) OVER (), 4) AS cum_pct FROM c")
def w7(spark, d):
    t = rel.running_shares(gps(spark, d).groupBy(F.hour("time").alias("hour")).agg(F.count("*").alias("n")), ["hour"])
    return t.withColumns({"pct": F.round("pct", 4), "cum_pct": F.round("cum_pct", 4)})


@R.query("w8_total_of_counts", "SELECT app_source, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM raw_gps GROUP BY app_source")
def w8(spark, d):
    c = raw(spark, d).groupBy("app_source").agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("total"))))


@R.query("w9_distinct_on", "SELECT DISTINCT ON (subid) subid, point_id, time FROM raw_gps ORDER BY subid, time DESC, point_id")
def w9(spark, d):
    return raw(spark, d).groupBy("subid").agg(F.max(F.struct("time", (-F.col("point_id")).alias("m"))).alias("f")).select("subid", (-F.col("f.m")).alias("point_id"), F.col("f.time").alias("time"))


# --- order, limits, top-k, samples


@R.query("t1_order_by", "SELECT subid, CAST(study_start AS VARCHAR) AS study_start, CAST(study_end AS VARCHAR) AS study_end FROM study_dates_gps ORDER BY study_start DESC, subid")
def t1(spark, d):
    return table(spark, d, "study_dates_gps").orderBy(F.desc("study_start"), "subid").select("subid", F.col("study_start").cast("string"), F.col("study_end").cast("string"))


@R.query("t2_limit", "SELECT point_id, subid, time FROM raw_gps ORDER BY time, point_id LIMIT 10")
def t2(spark, d):
    return raw(spark, d).select("point_id", "subid", "time").orderBy("time", "point_id").limit(10)


@R.query("t3_top_of_group_no_ties", "SELECT subid, processed_id, speed_mph FROM (SELECT *, row_number() OVER (PARTITION BY subid ORDER BY speed_mph DESC, processed_id) AS r FROM processed_gps WHERE speed_mph IS NOT NULL) WHERE r = 1")
def t3(spark, d):
    return rel.first_per_group(gps(spark, d).filter("speed_mph IS NOT NULL").select("subid", "processed_id", "speed_mph"), ["subid"], [F.desc("speed_mph"), "processed_id"])


@R.query("t4_top_of_group_with_ties", "SELECT subid, processed_id, dwell_time_seconds FROM (SELECT *, rank() OVER (PARTITION BY subid ORDER BY dwell_time_seconds DESC NULLS LAST) AS r FROM processed_gps) WHERE r = 1 AND dwell_time_seconds IS NOT NULL")
def t4(spark, d):
    return rel.in_largest_value(gps(spark, d).select("subid", "processed_id", "dwell_time_seconds"), ["subid"], "dwell_time_seconds")


@R.query("t5_first_k_of_group", "SELECT subid, utc, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY subid ORDER BY utc, lat, lon) AS r FROM (SELECT DISTINCT subid, utc, lat, lon FROM locations)) WHERE r <= 2")
def t5(spark, d):
    return rel.first_per_group(table(spark, d, "locations").select("subid", "utc", "lat", "lon").distinct(), ["subid"], ["utc", "lat", "lon"], 2)


@R.query("t6_random_sample", "SELECT point_id, subid FROM raw_gps ORDER BY md5(CAST(point_id AS VARCHAR) || ':42'), point_id LIMIT 1000")
def t6(spark, d):
    return rel.sample_rows(raw(spark, d).select("point_id", "subid"), 1000, "point_id")


@R.query("t7_two_ends", "(SELECT osm_type, osm_id, area_sqkm, 'highest' AS \"end\" FROM osm_landuse WHERE area_sqkm IS NOT NULL AND NOT isnan(area_sqkm) ORDER BY area_sqkm DESC, osm_id LIMIT 5) UNION ALL (SELECT osm_type, osm_id, area_sqkm, 'lowest' FROM osm_landuse WHERE area_sqkm IS NOT NULL AND NOT isnan(area_sqkm) ORDER BY area_sqkm, osm_id LIMIT 5)")
def t7(spark, d):
    t = table(spark, d, "osm_landuse").filter("NOT isnan(area_sqkm)").select("osm_type", "osm_id", "area_sqkm")
    return rel.two_ends(t, "area_sqkm", "osm_id")


@R.query("t8_argmax_first_wins", "SELECT subid, hour, n FROM (SELECT *, row_number() OVER (PARTITION BY subid ORDER BY n DESC, hour) AS r FROM (SELECT subid, hour(time) AS hour, count(*) AS n FROM processed_gps GROUP BY ALL)) WHERE r = 1")
def t8(spark, d):
    n = gps(spark, d).groupBy("subid", F.hour("time").alias("hour")).agg(F.count("*").alias("n"))
    return n.groupBy("subid").agg(F.max(F.struct("n", (-F.col("hour")).alias("h"))).alias("m")).select("subid", (-F.col("m.h")).alias("hour"), F.col("m.n").alias("n"))


@R.query("t9_exemplars", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY n, type) AS i, count(*) OVER (PARTITION BY class) AS k FROM (SELECT class, type, count(*) AS n FROM osm_poi GROUP BY ALL)) SELECT class, type, n, 'min' AS pick FROM r WHERE i = 1 UNION ALL SELECT class, type, n, 'median' FROM r WHERE i = (k + 1) // 2 UNION ALL SELECT class, type, n, 'max' FROM r WHERE i = k")
def t9(spark, d):
    return rel.exemplars(table(spark, d, "osm_poi").groupBy("class", "type").agg(F.count("*").alias("n")), ["class"], ["n", "type"])


# --- sets


@R.query("g1_union_all", "SELECT subid, lat, lon, 'raw' AS kind FROM raw_gps UNION ALL SELECT subid, lat, lon, 'reported' FROM locations")
def g1(spark, d):
    cols = ["subid", "lat", "lon"]
    return raw(spark, d).select(*cols, F.lit("raw").alias("kind")).unionByName(table(spark, d, "locations").select(*cols, F.lit("reported").alias("kind")))


@R.query("g2_bind_rows", "SELECT 'locations' AS source, subid, type, NULL::VARCHAR AS study_start FROM locations UNION ALL SELECT 'study', subid, NULL, CAST(study_start AS VARCHAR) FROM study_dates_gps")
def g2(spark, d):
    a = table(spark, d, "locations").select(F.lit("locations").alias("source"), "subid", "type")
    return a.unionByName(table(spark, d, "study_dates_gps").select(F.lit("study").alias("source"), "subid", F.col("study_start").cast("string")), allowMissingColumns=True)


@R.query("g3_distinct", "SELECT DISTINCT subid, CAST(CAST(time AS DATE) AS VARCHAR) AS day FROM raw_gps")
def g3(spark, d):
    return raw(spark, d).select("subid", F.to_date("time").cast("string").alias("day")).distinct()


@R.query("g4_key_sets", "SELECT subid, 'both' AS kind FROM (SELECT subid FROM locations INTERSECT SELECT subid FROM raw_gps) UNION ALL SELECT subid, 'never seen' FROM (SELECT subid FROM study_dates_gps EXCEPT SELECT subid FROM raw_gps) UNION ALL SELECT subid, 'no report' FROM (SELECT subid FROM raw_gps EXCEPT SELECT subid FROM locations)")
def g4(spark, d):
    a, b, s = (table(spark, d, n).select("subid") for n in ("locations", "raw_gps", "study_dates_gps"))
    label = lambda t, k: t.withColumn("kind", F.lit(k))
    return label(a.intersect(b), "both").unionByName(label(s.subtract(b), "never seen")).unionByName(label(b.distinct().join(a, "subid", "left_anti"), "no report"))


@R.query("g5_scalar_subqueries", f"SELECT (SELECT count(*) FROM {POI}) AS n_all, (SELECT count(*) FROM {POI} WHERE NOT {X.matches_sql(X.NOT_VISITABLE[0])}) AS n_kept, (SELECT count(*) FROM {POI}) - (SELECT count(*) FROM {POI} WHERE NOT {X.matches_sql(X.NOT_VISITABLE[0])}) AS n_dropped")
def g5(spark, d):
    t = poi(spark, d).agg(F.count("*").alias("n_all"), F.count_if(~X.matches(X.NOT_VISITABLE[0])).alias("n_kept"))
    return t.withColumn("n_dropped", F.col("n_all") - F.col("n_kept"))


# --- scalar functions


@R.query("m1_math", "SELECT processed_id, round(ln(dwell_time_seconds + 1), 6) AS log_gap, round(sqrt(dwell_time_seconds), 6) AS root_gap, CAST(ceil(dwell_time_seconds / 60.0) AS BIGINT) AS minutes_up, CASE WHEN dwell_time_seconds <> 0 THEN round(1.0::DOUBLE / dwell_time_seconds, 9) END AS inverse FROM processed_gps WHERE dwell_time_seconds >= 0")
def m1(spark, d):
    g = F.col("dwell_time_seconds")
    return gps(spark, d).filter(g >= 0).select("processed_id", F.round(F.log(g + F.lit(1.0)), 6).alias("log_gap"), F.round(F.sqrt(g), 6).alias("root_gap"), F.ceil(g / 60).cast("long").alias("minutes_up"), F.round(F.try_divide(F.lit(1.0), g.cast("double")), 9).alias("inverse"))


@R.query("m2_rounding", "SELECT x, up, even FROM (VALUES (0.125::DOUBLE, 0.13::DOUBLE, 0.12::DOUBLE), (0.375, 0.38, 0.38), (2.5, 2.5, 2.5), (-0.125, -0.13, -0.12)) v(x, up, even)")
def m2(spark, d):
    t = spark.createDataFrame([(0.125,), (0.375,), (2.5,), (-0.125,)], "x double")
    return t.select("x", F.round("x", 2).alias("up"), F.bround("x", 2).alias("even"))


@R.query("m3_conversion", "SELECT processed_id, round(dist_miles * 1609.344, 3) AS metres, round(dist_miles * 1609.344 * 3.28084, 3) AS feet, round(dist_miles * 1.609344, 6) AS km FROM processed_gps")
def m3(spark, d):
    m = F.col("dist_miles") * 1609.344
    return gps(spark, d).select("processed_id", F.round(m, 3).alias("metres"), F.round(m * 3.28084, 3).alias("feet"), F.round(F.col("dist_miles") * 1.609344, 6).alias("km"))


@R.query("d1_date_time", "SELECT processed_id, timezone('America/Chicago', timezone('UTC', time)) AS wall, CAST(CAST(time AS DATE) + 7 AS VARCHAR) AS a_week_on, strftime(time, '%Y-%m-%d %H:%M:%S') AS label, round((epoch_us(time) - epoch_us(TIMESTAMP '2014-01-01')) / 86400e6, 3) AS days, CAST(CAST(time AS DATE) AS TIMESTAMP) + INTERVAL 86399 SECOND AS day_end FROM processed_gps")
def d1(spark, d):
    t = localise(gps(spark, d).select("processed_id", "time"), to="wall")
    return t.select("processed_id", "wall", F.date_add(F.to_date("time"), 7).cast("string").alias("a_week_on"), F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("label"), F.round(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2014-01-01', time) / 86400e6D"), 3).alias("days"), F.expr("timestampadd(SECOND, 86399, cast(to_date(time) AS timestamp_ntz))").alias("day_end"))


@R.query("st1_strings", "SELECT osm_type, osm_id, class || ' - ' || type AS kind, upper(substr(class, 1, 1)) || substr(class, 2) AS title, substr(type, 1, 3) AS short, printf('%05d', osm_id % 100000) AS code, concat_ws(', ', nullif(street, ''), nullif(city, '')) AS address FROM (SELECT DISTINCT osm_type, osm_id, class, type, street, city FROM osm_poi)")
def st1(spark, d):
    t = table(spark, d, "osm_poi").select("osm_type", "osm_id", "class", "type", "street", "city").distinct()
    return t.select("osm_type", "osm_id", F.concat("class", F.lit(" - "), "type").alias("kind"), F.initcap("class").alias("title"), F.substring("type", 1, 3).alias("short"), F.format_string("%05d", F.col("osm_id") % 100000).alias("code"), F.concat_ws(", ", F.nullif("street", F.lit("")), F.nullif("city", F.lit(""))).alias("address"))


@R.query("cd1_conditionals", "SELECT processed_id, CASE WHEN speed_mph IS NULL THEN NULL WHEN speed_mph <= 4 THEN 'slow' ELSE 'fast' END AS pace, CASE hour(time) // 6 WHEN 0 THEN 'night' WHEN 1 THEN 'morning' WHEN 2 THEN 'afternoon' ELSE 'evening' END AS part FROM processed_gps")
def cd1(spark, d):
    v, q = F.col("speed_mph"), F.floor(F.hour("time") / 6)
    return gps(spark, d).select("processed_id", F.when(v.isNull(), None).when(v <= 4, "slow").otherwise("fast").alias("pace"), F.when(q == 0, "night").when(q == 1, "morning").when(q == 2, "afternoon").otherwise("evening").alias("part"))


@R.query("nl1_nulls", "SELECT processed_id, speed_mph IS NULL AS no_speed, coalesce(speed_mph, dist_miles, -1) AS filled, nullif(dwell_time_seconds, 0) AS gap FROM processed_gps")
def nl1(spark, d):
    return gps(spark, d).select("processed_id", F.col("speed_mph").isNull().alias("no_speed"), F.coalesce("speed_mph", "dist_miles", F.lit(-1.0)).alias("filled"), F.nullif("dwell_time_seconds", F.lit(0)).alias("gap"))


@R.query("ar1_arrays", "SELECT subid, CAST(study_start + CAST(w AS INTEGER) AS VARCHAR) AS window_end, w AS days FROM (SELECT subid, study_start, unnest(range(7, 29, 7)) AS w FROM study_dates_gps)")
def ar1(spark, d):
    t = table(spark, d, "study_dates_gps").withColumn("days", F.explode(F.sequence(F.lit(7), F.lit(28), F.lit(7))))
    return t.select("subid", F.date_add("study_start", F.col("days")).cast("string").alias("window_end"), F.col("days").cast("long").alias("days"))


@R.query("cs1_casts", "SELECT DISTINCT subid, CAST(utc AS VARCHAR) AS utc_text, CAST(lat AS INTEGER) = round(lat) AS rounded, TRY_CAST(type AS INTEGER) IS NULL AS no_number, CAST(subid AS DOUBLE) AS subid_d FROM locations")
def cs1(spark, d):
    t = table(spark, d, "locations")
    return t.select("subid", F.col("utc").cast("string").alias("utc_text"), (F.round("lat").cast("int") == F.round("lat")).alias("rounded"), F.col("type").try_cast("int").isNull().alias("no_number"), F.col("subid").cast("double").alias("subid_d")).distinct()


# --- reshaping


@R.query("r1_pivot_longer", "SELECT subid, 'study_start' AS name, CAST(study_start AS VARCHAR) AS value FROM study_dates_gps UNION ALL SELECT subid, 'study_end', CAST(study_end AS VARCHAR) FROM study_dates_gps")
def r1(spark, d):
    return table(spark, d, "study_dates_gps").unpivot("subid", ["study_start", "study_end"], "name", "value").withColumn("value", F.col("value").cast("string"))


@R.query("r2_pivot_wider", "SELECT subid, count(*) FILTER (WHERE lower(type) = 'home') AS home, count(*) FILTER (WHERE lower(type) = 'work') AS work, count(*) FILTER (WHERE lower(type) = 'bar') AS bar FROM locations GROUP BY subid")
def r2(spark, d):
    return table(spark, d, "locations").withColumn("kind", F.lower("type")).groupBy("subid").pivot("kind", ["home", "work", "bar"]).agg(F.count(F.lit(1))).fillna(0)


@R.query("r3_separate", "SELECT name, regexp_extract(name, '^(.*)_[^_]*$', 1) AS left_part, regexp_extract(name, '_([^_]*)$', 1) AS right_part FROM (SELECT DISTINCT class || '_' || type AS name FROM osm_poi)")
def r3(spark, d):
    t = table(spark, d, "osm_poi").select(F.concat_ws("_", "class", "type").alias("name")).distinct()
    return t.select("name", F.regexp_extract("name", "^(.*)_[^_]*$", 1).alias("left_part"), F.regexp_extract("name", "_([^_]*)$", 1).alias("right_part"))


@R.query("r4_separate_rows", "SELECT type, unnest(string_split(type, '_')) AS part FROM (SELECT DISTINCT type FROM osm_poi)")
def r4(spark, d):
    t = table(spark, d, "osm_poi").select("type").distinct()
    return t.select("type", F.explode(F.split("type", "_")).alias("part"))


@R.query("r5_unnest", "SELECT subid, 'n' AS measure, CAST(count(*) AS DOUBLE) AS value FROM locations GROUP BY subid UNION ALL SELECT subid, 'first', CAST(min(utc) AS DOUBLE) FROM locations GROUP BY subid")
def r5(spark, d):
    t = table(spark, d, "locations").groupBy("subid").agg(F.count("*").alias("n"), F.min("utc").alias("first"))
    pair = lambda c: F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value"))
    return t.select("subid", F.inline(F.array(pair("n"), pair("first"))))
