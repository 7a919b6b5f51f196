"""Queries of the spatial operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import taxonomy as X
from ..operators import polygons as P
from ..operators.proximity import nearest, point_of, radius_counts, radius_join, visit_match
from .registry import Registry, sql_haversine, table

R = Registry()
KEYS = ["osm_type", "osm_id"]
PREMISES = X.PREMISE_PINGS

POI = "poi AS (SELECT DISTINCT osm_type, osm_id, class, type, cast(regexp_extract(geom, 'POINT *[(] *([-0-9.]+)', 1) AS DOUBLE) AS olon, cast(regexp_extract(geom, 'POINT *[(] *[-0-9.]+ +([-0-9.]+)', 1) AS DOUBLE) AS olat FROM osm_poi)"
OUTLETS = f"{POI}, outlet AS (SELECT *, {X.classify_sql(PREMISES)} AS category FROM poi WHERE {X.classify_sql(PREMISES)} IS NOT NULL)"
RINGS = """ring AS (SELECT osm_type, osm_id, i, list_transform(string_split(r, ','), lambda q: list_transform(string_split(trim(q), ' '), lambda v: cast(v AS DOUBLE))) AS p FROM
 (SELECT osm_type, osm_id, unnest(regexp_extract_all(geom, '[(]([^()]+)[)]', 1)) AS r, unnest(range(1, len(regexp_extract_all(geom, '[(]([^()]+)[)]', 1)) + 1)) AS i FROM (SELECT DISTINCT osm_type, osm_id, geom FROM osm_landuse WHERE geom IS NOT NULL)))"""
DIST = sql_haversine("g.lon", "g.lat", "o.olon", "o.olat")


def fixes(spark, d):
    return table(spark, d, "processed_gps").select("processed_id", "lat", "lon")


def poi(spark, d):
    x, y = point_of("geom")
    return table(spark, d, "osm_poi").select(*KEYS, "class", "type", x.alias("olon"), y.alias("olat")).distinct()


def outlets(spark, d):
    return poi(spark, d).withColumn("category", X.classify(PREMISES)).filter("category IS NOT NULL")


def landuse(spark, d):
    return table(spark, d, "osm_landuse")


@R.query("j1_haversine", f"SELECT processed_id, round({sql_haversine('lon', 'lat', '-89.4', '43.07')}, 2) AS metres FROM processed_gps")
def j1(spark, d):
    return fixes(spark, d).select("processed_id", F.round(G.haversine_m("lon", "lat", F.lit(-89.4), F.lit(43.07)), 2).alias("metres"))


@R.query("j2_points_and_accessors", f"WITH {POI} SELECT osm_type, osm_id, olon AS x, olat AS y FROM poi")
def j2(spark, d):
    return poi(spark, d).select(*KEYS, F.col("olon").alias("x"), F.col("olat").alias("y"))


@R.query("j3_box_overlap", f"WITH {RINGS}, b AS (SELECT osm_type, osm_id, min(list_min(list_transform(p, lambda v: v[1]))) AS x0, max(list_max(list_transform(p, lambda v: v[1]))) AS x1, min(list_min(list_transform(p, lambda v: v[2]))) AS y0, max(list_max(list_transform(p, lambda v: v[2]))) AS y1 FROM ring GROUP BY ALL) SELECT osm_type, osm_id FROM b WHERE x0 <= -89.0 AND x1 >= -91.5 AND y0 <= 44.5 AND y1 >= 42.8")
def j3(spark, d):
    return P.measures(landuse(spark, d), KEYS).filter("xmin <= -89.0 AND xmax >= -91.5 AND ymin <= 44.5 AND ymax >= 42.8").select(*KEYS)


@R.query("j3_points_in_box", "SELECT point_id FROM raw_gps WHERE lon BETWEEN -90.5 AND -88.0 AND lat BETWEEN 42.6 AND 44.0")
def j3_points(spark, d):
    return table(spark, d, "raw_gps").filter(G.in_bbox("lon", "lat", -90.5, 42.6, -88.0, 44.0)).select("point_id")


_INSIDE = """inside AS (SELECT g.processed_id, e.osm_type, e.osm_id FROM processed_gps g JOIN
(SELECT *, min(least(x1, x2)) OVER w AS bx1, max(greatest(x1, x2)) OVER w AS bx2, min(least(y1, y2)) OVER w AS by1, max(greatest(y1, y2)) OVER w AS by2 FROM
 (SELECT osm_type, osm_id, p[j][1] AS x1, p[j][2] AS y1, p[j + 1][1] AS x2, p[j + 1][2] AS y2 FROM (SELECT *, unnest(range(1, len(p))) AS j FROM ring)) WINDOW w AS (PARTITION BY osm_type, osm_id)) e
ON g.lon BETWEEN e.bx1 AND e.bx2 AND g.lat BETWEEN e.by1 AND e.by2 GROUP BY ALL
HAVING count(*) FILTER (WHERE (e.x1 > g.lon) <> (e.x2 > g.lon) AND e.y1 + (g.lon - e.x1) / (e.x2 - e.x1) * (e.y2 - e.y1) > g.lat) % 2 = 1)"""


@R.query("j4_regions_of_points", f"WITH {RINGS}, {_INSIDE}, facts AS (SELECT osm_type, osm_id, min(type) AS type, min(name) AS name FROM osm_landuse GROUP BY ALL) SELECT g.processed_id, i.osm_id, f.type, f.name FROM processed_gps g LEFT JOIN inside i USING (processed_id) LEFT JOIN facts f ON i.osm_type = f.osm_type AND i.osm_id = f.osm_id")
def j4(spark, d):
    return P.with_regions(fixes(spark, d), landuse(spark, d), "processed_id", KEYS, ["osm_id", "type", "name"]).select("processed_id", "osm_id", "type", "name")


@R.query("c13_spatial_left_join", f"WITH {RINGS}, {_INSIDE} SELECT g.processed_id, count(i.osm_id) AS n_regions FROM processed_gps g LEFT JOIN inside i USING (processed_id) GROUP BY ALL")
def c13(spark, d):
    t = P.with_regions(fixes(spark, d), landuse(spark, d), "processed_id", KEYS, ["osm_id"])
    return t.groupBy("processed_id").agg(F.count("osm_id").alias("n_regions"))


_NEAREST = f"WITH {OUTLETS}, r AS (SELECT g.processed_id, o.category, {DIST} AS m, sqrt(pow(g.lon - o.olon, 2) + pow(g.lat - o.olat, 2)) AS deg, osm_type, osm_id FROM processed_gps g, outlet o)"


@R.query("j5_nearest_by_category", f"{_NEAREST} SELECT processed_id, category, round(min(m), 1) AS dist_m FROM r GROUP BY ALL")
def j5(spark, d):
    return nearest(fixes(spark, d), outlets(spark, d), "processed_id", "category", KEYS).select("processed_id", "category", F.round("dist_m", 1).alias("dist_m"))


@R.query("j5_nearest_by_degrees", f"{_NEAREST}, b AS (SELECT processed_id, category, min((deg, osm_type, osm_id, m)) AS b FROM r GROUP BY ALL) SELECT processed_id, category, round(b[4], 1) AS dist_m FROM b")
def j5_degrees(spark, d):
    return nearest(fixes(spark, d), outlets(spark, d), "processed_id", "category", KEYS, rank_by="degrees").select("processed_id", "category", F.round("dist_m", 1).alias("dist_m"))


@R.query("c11_lateral_nearest_five", f"WITH {POI}, r AS (SELECT l.subid, l.utc, l.lat, l.lon, o.osm_type, o.osm_id, row_number() OVER (PARTITION BY l.subid, l.utc, l.lat, l.lon ORDER BY {sql_haversine('l.lon', 'l.lat', 'o.olon', 'o.olat')}, o.osm_type, o.osm_id) AS k FROM (SELECT DISTINCT subid, utc, lat, lon FROM locations) l, poi o WHERE {sql_haversine('l.lon', 'l.lat', 'o.olon', 'o.olat')} <= 5000) SELECT subid, utc, lat, lon, osm_type, osm_id, k::INTEGER AS k FROM r WHERE k <= 5")
def c11(spark, d):
    from pyspark.sql import Window

    t = table(spark, d, "locations").select("subid", "utc", "lat", "lon").distinct()
    near = radius_join(t, poi(spark, d).drop("class", "type"), 5000.0)
    w = Window.partitionBy("subid", "utc", "lat", "lon").orderBy("dist_m", *KEYS)
    return near.withColumn("k", F.row_number().over(w)).filter("k <= 5").select("subid", "utc", "lat", "lon", *KEYS, "k")


_RADII = [100, 250, 500, 1000]


def _counts_sql(dist: str) -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE o.category = '{c}' AND {dist} <= {r}) AS n_{c}_{r}" for c in ("on_premise", "off_premise") for r in _RADII)
    return f"WITH {OUTLETS} SELECT g.processed_id, {cols} FROM processed_gps g LEFT JOIN outlet o ON o.olat BETWEEN g.lat - 0.02 AND g.lat + 0.02 AND o.olon BETWEEN g.lon - 0.03 AND g.lon + 0.03 GROUP BY g.processed_id"


@R.query("j6_radius_counts", _counts_sql(DIST))
def j6(spark, d):
    return radius_counts(fixes(spark, d), outlets(spark, d), "processed_id", "category", ["on_premise", "off_premise"], _RADII)


_MERC = "sqrt(pow(6378137.0 * (radians(g.lon) - radians(o.olon)), 2) + pow(6378137.0 * (ln(tan(pi() / 4 + radians(g.lat) / 2)) - ln(tan(pi() / 4 + radians(o.olat) / 2))), 2))"


@R.query("j6_radius_counts_mercator", _counts_sql(_MERC).replace("FROM processed_gps g", "FROM (SELECT * FROM processed_gps WHERE abs(lat) < 85) g"))
def j6_mercator(spark, d):
    return radius_counts(fixes(spark, d).filter("abs(lat) < 85"), outlets(spark, d), "processed_id", "category", ["on_premise", "off_premise"], _RADII, "mercator")


@R.query("c12_theta_left_join", f"WITH {POI} SELECT l.subid, l.lat, l.lon, count(o.osm_id) AS n_near FROM (SELECT DISTINCT subid, lat, lon FROM locations) l LEFT JOIN poi o ON {sql_haversine('l.lon', 'l.lat', 'o.olon', 'o.olat')} <= 500 GROUP BY ALL")
def c12(spark, d):
    t = table(spark, d, "locations").select("subid", "lat", "lon").distinct()
    near = radius_join(t, poi(spark, d).drop("class", "type"), 500.0).groupBy("subid", "lat", "lon").agg(F.count("*").alias("n_near"))
    return t.join(near, ["subid", "lat", "lon"], "left").fillna({"n_near": 0})


@R.query("j7_visit_match", f"WITH {POI}, vis AS (SELECT * FROM poi WHERE NOT {X.matches_sql(X.NOT_VISITABLE[0])}), r AS (SELECT g.processed_id, o.class, o.type, {DIST} AS m, row_number() OVER (PARTITION BY g.processed_id ORDER BY sqrt(pow(g.lon - o.olon, 2) + pow(g.lat - o.olat, 2)), o.osm_type, o.osm_id) AS k FROM processed_gps g JOIN vis o ON o.olat BETWEEN g.lat - 0.05 AND g.lat + 0.05 AND o.olon BETWEEN g.lon - 0.05 AND g.lon + 0.05), ok AS (SELECT *, row_number() OVER (PARTITION BY processed_id ORDER BY k) AS first FROM r WHERE k <= 5 AND m <= 50) SELECT processed_id, class AS pass_class, type AS pass_type, round(m, 2) AS pass_distance_m FROM ok WHERE first = 1")
def j7(spark, d):
    vis = poi(spark, d).filter(~X.matches(X.NOT_VISITABLE[0]))
    t = visit_match(fixes(spark, d), vis, "processed_id", KEYS, ["class", "type"])
    return t.select("processed_id", F.col("class").alias("pass_class"), F.col("type").alias("pass_type"), F.round("dist_m", 2).alias("pass_distance_m"))


@R.query("j8_mercator", "SELECT point_id, round(6378137.0 * radians(lon), 3) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y, round(lon, 9) AS lon_back, round(lat, 9) AS lat_back FROM raw_gps WHERE abs(lat) < 85")
def j8(spark, d):
    t = table(spark, d, "raw_gps").filter("abs(lat) < 85").select("point_id", G.mercator_x("lon").alias("x"), G.mercator_y("lat").alias("y"))
    lon, lat = G.from_mercator("x", "y")
    return t.select("point_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 9).alias("lon_back"), F.round(lat, 9).alias("lat_back"))


@R.query("j8_utm_round_trip", "SELECT point_id, round(lon, 7) AS lon_back, round(lat, 7) AS lat_back FROM raw_gps WHERE lat BETWEEN 40 AND 50 AND lon BETWEEN -94 AND -84")
def j8_utm(spark, d):
    e, n = G.utm("lon", "lat")
    t = table(spark, d, "raw_gps").filter("lat BETWEEN 40 AND 50 AND lon BETWEEN -94 AND -84").select("point_id", e.alias("e"), n.alias("n"))
    lon, lat = G.from_utm("e", "n")
    return t.select("point_id", F.round(lon, 7).alias("lon_back"), F.round(lat, 7).alias("lat_back"))


_EXTENT = "SELECT min(6378137.0 * radians(lon)) AS x0, min(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2))) AS y0, max(6378137.0 * radians(lon)) AS x1, max(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2))) AS y1 FROM osm_poi WHERE lon IS NOT NULL AND lat IS NOT NULL"


@R.query("j9_square_grid", f"WITH e AS ({_EXTENT}), n AS (SELECT *, CAST(ceil((x1 - x0) / 7620) AS BIGINT) AS nx, CAST(ceil((y1 - y0) / 7620) AS BIGINT) AS ny FROM e), c AS (SELECT *, unnest(range(0, nx * ny)) AS id FROM n) SELECT id + 1 AS cell_id, round(x0 + (id % nx + 0.5) * 7620, 2) AS x, round(y0 + (id // nx + 0.5) * 7620, 2) AS y FROM c")
def j9(spark, d):
    t = table(spark, d, "osm_poi").filter("lon IS NOT NULL AND lat IS NOT NULL")
    x, y = G.mercator_x("lon"), G.mercator_y("lat")
    e = t.agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1")).first()
    return P.square_grid(e["x0"], e["y0"], e["x1"], e["y1"], 7620.0, spark).select("cell_id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@R.query("j10_overlay_of_regions")
def j10(spark, d):
    return P.overlaps(landuse(spark, d), KEYS)


@R.query("j11_regions_clipped_to_grid")
def j11(spark, d):
    return P.clip_to_grid(landuse(spark, d), KEYS, 0.005)


_AREA = f"WITH {RINGS}, a AS (SELECT osm_type, osm_id, i, list_sum(list_transform(range(1, len(p)), lambda k: (p[k][1] - p[1][1]) * (p[k + 1][2] - p[1][2]) - (p[k + 1][1] - p[1][1]) * (p[k][2] - p[1][2]))) / 2 AS a FROM ring), one AS (SELECT osm_type, osm_id FROM a GROUP BY ALL HAVING count(*) = 1)"


@R.query("j11_clipped_area_is_whole", f"{_AREA} SELECT osm_type, osm_id, round(abs(a) * 1e6, 4) AS area FROM a JOIN one USING (osm_type, osm_id)")
def j11_whole(spark, d):
    one = P.measures(landuse(spark, d), KEYS).filter("n_rings = 1").select(*KEYS)
    return P.clip_to_grid(landuse(spark, d), KEYS, 0.005).join(one, KEYS, "left_semi").groupBy(*KEYS).agg(F.round(F.sum("area") * 1e6, 4).alias("area"))


@R.query("j12_land_share_of_cells")
def j12(spark, d):
    t = P.clip_to_grid(landuse(spark, d), KEYS, 0.01).groupBy("ix", "iy").agg(F.sum("share").alias("covered"), F.count("*").alias("n_regions"))
    return t.filter("covered > 0")


@R.query("j12_areas", f"WITH {RINGS}, m AS (SELECT osm_type, osm_id, i, list_transform(p, lambda v: [6378137.0 * radians(v[1]), 6378137.0 * ln(tan(pi() / 4 + radians(v[2]) / 2))]) AS q FROM ring), n AS (SELECT osm_type, osm_id FROM ring GROUP BY ALL HAVING count(*) = 1) SELECT osm_type, osm_id, round(abs(list_sum(list_transform(range(1, len(q)), lambda k: (q[k][1] - q[1][1]) * (q[k + 1][2] - q[1][2]) - (q[k + 1][1] - q[1][1]) * (q[k][2] - q[1][2]))) / 2) / 1e6, 6) AS sqkm FROM m JOIN n USING (osm_type, osm_id)")
def j12_areas(spark, d):
    return P.measures(landuse(spark, d), KEYS).filter("n_rings = 1").select(*KEYS, F.round(F.col("area_mercator") / 1e6, 6).alias("sqkm"))


@R.query("j13_centroids", f"{_AREA} SELECT osm_type, osm_id, round(p[1][1] + list_sum(list_transform(range(1, len(p)), lambda k: (p[k][1] + p[k + 1][1] - 2 * p[1][1]) * ((p[k][1] - p[1][1]) * (p[k + 1][2] - p[1][2]) - (p[k + 1][1] - p[1][1]) * (p[k][2] - p[1][2])))) / (6 * a), 7) AS cx, round(p[1][2] + list_sum(list_transform(range(1, len(p)), lambda k: (p[k][2] + p[k + 1][2] - 2 * p[1][2]) * ((p[k][1] - p[1][1]) * (p[k + 1][2] - p[1][2]) - (p[k + 1][1] - p[1][1]) * (p[k][2] - p[1][2])))) / (6 * a), 7) AS cy FROM ring JOIN a USING (osm_type, osm_id, i) JOIN one USING (osm_type, osm_id)")
def j13(spark, d):
    return P.measures(landuse(spark, d), KEYS).filter("n_rings = 1").select(*KEYS, F.round("cx", 7).alias("cx"), F.round("cy", 7).alias("cy"))


def map_objects(spark, d):
    """Map objects with tags, as a decoded extract holds them, from the two feature tables."""
    name = {"N": "node", "W": "way", "R": "relation"}
    kind = F.coalesce(*(F.when(F.col("osm_type") == k, v) for k, v in name.items()))
    a = table(spark, d, "osm_poi").dropDuplicates(KEYS).select(kind.alias("kind"), "osm_id", F.map_from_arrays(F.array("class", F.lit("name")), F.array("type", "name")).alias("tags"), F.lit(True).alias("is_closed"), "geom")
    b = landuse(spark, d).dropDuplicates(KEYS).select(kind.alias("kind"), "osm_id", F.map_from_arrays(F.array(F.lit("landuse"), F.lit("leisure")), F.array("type", F.lit("yes"))).alias("tags"), (F.col("osm_id") % 2 == 0).alias("is_closed"), "geom")
    return a.unionByName(b)


@R.query("j14_tag_rules", "SELECT 'poi' AS layer, class, type, count(*) AS n FROM (SELECT DISTINCT osm_type, osm_id, class, type FROM osm_poi) GROUP BY ALL UNION ALL SELECT 'landuse', 'landuse', type, count(*) FROM (SELECT DISTINCT ON (osm_type, osm_id) osm_type, osm_id, type FROM osm_landuse) WHERE osm_type = 'R' OR (osm_type = 'W' AND osm_id % 2 = 0) GROUP BY ALL")
def j14(spark, d):
    poi, land = P.map_features(map_objects(spark, d))
    count = lambda t, layer: t.groupBy(F.lit(layer).alias("layer"), "class", "type").agg(F.count("*").alias("n"))
    return count(poi, "poi").unionByName(count(land, "landuse"))


@R.query("j15_simplify")
def j15(spark, d):
    return P.simplified(landuse(spark, d), KEYS, 0.001)


@R.query("j16_multipolygon_and_plain", "SELECT DISTINCT osm_type, osm_id, CASE WHEN geom IS NULL THEN NULL WHEN regexp_matches(upper(geom), 'MULTIPOLYGON') THEN regexp_replace(regexp_replace(geom, '^SRID=[0-9]+; *', ''), '^(?i)MULTIPOLYGON *', 'MULTIPOLYGON ') ELSE 'MULTIPOLYGON (' || regexp_replace(regexp_replace(geom, '^SRID=[0-9]+; *', ''), '^(?i)POLYGON *', '') || ')' END AS geom FROM osm_landuse")
def j16(spark, d):
    text = F.regexp_replace("geom", "^SRID=[0-9]+; *", "")
    multi = F.when(F.upper("geom").contains("MULTIPOLYGON"), F.regexp_replace(text, "^(?i)MULTIPOLYGON *", "MULTIPOLYGON ")).when(F.col("geom").isNotNull(), F.concat(F.lit("MULTIPOLYGON ("), F.regexp_replace(text, "^(?i)POLYGON *", ""), F.lit(")")))
    return landuse(spark, d).select(*KEYS, multi.alias("geom")).distinct()


_TIERS = [(r[0], 1 if i < 4 else 2) for i, r in enumerate(X.CATEGORIES)]


@R.query("j17_objects_in_extent", f"WITH {POI}, b AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM processed_gps WHERE lat BETWEEN 42 AND 47 AND lon BETWEEN -93 AND -86), c AS (SELECT {X.classify_sql(X.CATEGORIES)} AS category FROM poi, b WHERE olon BETWEEN x0 AND x1 AND olat BETWEEN y0 AND y1) SELECT t.category, t.tier, count(c.category) AS n FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)}, {t})' for c, t in _TIERS)}) t(category, tier) LEFT JOIN c USING (category) GROUP BY ALL")
def j17(spark, d):
    box = fixes(spark, d).filter(G.in_bbox("lon", "lat", -93, 42, -86, 47)).agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    n = poi(spark, d).crossJoin(F.broadcast(box)).filter("olon BETWEEN x0 AND x1 AND olat BETWEEN y0 AND y1").groupBy(X.classify(X.CATEGORIES).alias("category")).agg(F.count("*").alias("n"))
    return spark.createDataFrame(_TIERS, "category string, tier int").join(n, "category", "left").fillna({"n": 0})
