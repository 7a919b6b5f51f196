"""Queries of the general large-scale problems over the location tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.accumulate import heavy_keys, key_totals
from ..operators.proximity import in_regions, near_points, point_of
from ..operators.readings import implausible_readings
from ..operators.sessions import from_micros, micros, sessions
from ..operators.trips import plausible_positions, stops_and_trips, visits_of
from ..session import materialize
from .registry import Registry, sql_haversine, table

R = Registry()


@R.query("p1_found", "SELECT subid FROM processed_gps GROUP BY subid HAVING count(*) >= 0.02 * (SELECT count(*) FROM processed_gps)")
def p1_found(spark, d):
    gps = table(spark, d, "processed_gps")
    return heavy_keys(gps, "subid").select(F.col("subid").cast("smallint").alias("subid"))


@R.query(
    "p1_subject_totals",
    "SELECT subid, count(*) AS n_fixes, min(time) AS first_fix, max(time) AS last_fix, round(coalesce(sum(dist_miles) FILTER (WHERE dist_miles >= 0 AND dist_miles <= 150 * dwell_time_seconds / 3600.0::DOUBLE), 0), 2) AS miles FROM processed_gps GROUP BY subid",
)
def p1_subject_totals(spark, d):
    # path length without steps that would need more than 150 miles an hour
    possible = (F.col("dist_miles") >= 0) & (F.col("dist_miles") <= 150 * F.col("dwell_time_seconds") / 3600)
    gps = table(spark, d, "processed_gps").select("subid", micros("time").alias("us"), F.when(possible, F.col("dist_miles")).alias("miles"))
    t = key_totals(gps, "subid", "us", "miles")
    return t.select(F.col("subid").cast("smallint").alias("subid"), F.col("rows").alias("n_fixes"), from_micros("first_us").alias("first_fix"), from_micros("last_us").alias("last_fix"), F.round("total", 2).alias("miles"))


_NEAR = """
SELECT DISTINCT processed_id, 'osm_poi' AS layer, osm_type, osm_id FROM processed_gps g JOIN
(SELECT DISTINCT osm_type, osm_id, cast(regexp_extract(geom, 'POINT *[(] *([-0-9.]+)', 1) AS DOUBLE) AS x, cast(regexp_extract(geom, 'POINT *[(] *[-0-9.]+ +([-0-9.]+)', 1) AS DOUBLE) AS y FROM osm_poi) o
ON g.lat BETWEEN o.y - 0.0003 AND o.y + 0.0003 AND g.lon BETWEEN o.x - 0.0005 AND o.x + 0.0005
WHERE 2 * 6378137.0 * asin(least(1, sqrt(pow(sin(radians(o.y - g.lat) / 2), 2) + cos(radians(g.lat)) * cos(radians(o.y)) * pow(sin(radians(o.x - g.lon) / 2), 2)))) <= 30
"""
_WITHIN = """
SELECT g.processed_id, 'osm_landuse' AS layer, e.osm_type, e.osm_id FROM processed_gps g JOIN
(SELECT osm_type, osm_id, x1, y1, x2, y2, min(least(x1, x2)) OVER w AS bx1, max(greatest(x1, x2)) OVER w AS bx2, min(least(y1, y2)) OVER w AS by1, max(greatest(y1, y2)) OVER w AS by2 FROM
 (SELECT osm_type, osm_id, p[i][1] AS x1, p[i][2] AS y1, p[i + 1][1] AS x2, p[i + 1][2] AS y2 FROM
  (SELECT osm_type, osm_id, p, unnest(range(1, len(p))) AS i FROM
   (SELECT osm_type, osm_id, list_transform(string_split(ring, ','), lambda q: list_transform(string_split(trim(q), ' '), lambda v: cast(v AS DOUBLE))) AS p FROM
    (SELECT osm_type, osm_id, unnest(regexp_extract_all(geom, '[(]([^()]+)[)]', 1)) AS ring FROM (SELECT DISTINCT osm_type, osm_id, geom FROM osm_landuse WHERE geom IS NOT NULL))))) WINDOW w AS (PARTITION BY osm_type, osm_id)) e
ON g.lon BETWEEN e.bx1 AND e.bx2 AND g.lat BETWEEN e.by1 AND e.by2
GROUP BY g.processed_id, e.osm_type, e.osm_id
HAVING count(*) FILTER (WHERE (e.x1 > g.lon) <> (e.x2 > g.lon) AND e.y1 + (g.lon - e.x1) / (e.x2 - e.x1) * (e.y2 - e.y1) > g.lat) % 2 = 1
"""


def _near(spark, d):
    gps = table(spark, d, "processed_gps").select("processed_id", "lat", "lon")
    x, y = point_of("geom")
    poi = table(spark, d, "osm_poi").select("osm_type", "osm_id", x.alias("ox"), y.alias("oy"))
    return near_points(gps, poi, "processed_id", ["osm_type", "osm_id"], 30.0, object_lon="ox", object_lat="oy").select("processed_id", F.lit("osm_poi").alias("layer"), "osm_type", "osm_id")


def _within(spark, d):
    gps = table(spark, d, "processed_gps").select("processed_id", "lat", "lon")
    return in_regions(gps, table(spark, d, "osm_landuse"), "processed_id", ["osm_type", "osm_id"]).select("processed_id", F.lit("osm_landuse").alias("layer"), "osm_type", "osm_id")


@R.query("p2_found", f"{_NEAR} UNION ALL {_WITHIN}")
def p2_found(spark, d):
    return _near(spark, d).unionByName(_within(spark, d))


@R.query("p3_found")
def p3_found(spark, d):
    return implausible_readings(table(spark, d, "processed_gps")).select("processed_id", "measure")


# the kinds that SQL can say: positions off the globe, and stuck speeds of fixes (rows processed twice are one fix)
_CERTAIN = """
WITH o AS (SELECT *, CASE WHEN time = lag(time) OVER w AND lat = lag(lat) OVER w AND lon = lag(lon) OVER w AND coalesce(speed_mph = lag(speed_mph) OVER w, true) AND coalesce(dist_miles = lag(dist_miles) OVER w, true) THEN 0 ELSE 1 END AS new FROM processed_gps WINDOW w AS (PARTITION BY subid ORDER BY time, processed_id)),
f AS (SELECT *, sum(new) OVER (PARTITION BY subid ORDER BY time, processed_id ROWS UNBOUNDED PRECEDING) AS fix FROM o),
v AS (SELECT subid, fix, min(speed_mph) AS v FROM f GROUP BY subid, fix HAVING min(speed_mph) IS NOT NULL),
b AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY subid ORDER BY fix) THEN 0 ELSE 1 END AS turn FROM v),
r AS (SELECT *, sum(turn) OVER (PARTITION BY subid ORDER BY fix) AS run FROM b),
n AS (SELECT *, count(*) OVER (PARTITION BY subid, run) AS n FROM r)
SELECT processed_id, 'lat' AS measure, 'bound' AS kind FROM processed_gps WHERE abs(lat) > 90 OR abs(lon) > 180
UNION ALL SELECT f.processed_id, 'speed_mph', 'stuck' FROM f JOIN n USING (subid, fix) WHERE n.n >= 5 AND n.turn = 0 AND n.v > 0 AND n.v <= 150 AND f.speed_mph IS NOT NULL
"""


@R.query("p3_certain", _CERTAIN)
def p3_certain(spark, d):
    gps = table(spark, d, "processed_gps")
    t = implausible_readings(gps).select("processed_id", "measure", "kind")
    speeds = gps.filter("speed_mph > 0 AND speed_mph <= 150").select("processed_id")
    stuck = t.filter("measure = 'speed_mph' AND kind = 'stuck'").join(speeds, "processed_id", "left_semi")
    return t.filter("measure = 'lat' AND kind = 'bound'").unionByName(stuck)


@R.query("p5_found")
def p5_found(spark, d):
    gps = table(spark, d, "processed_gps")
    n = gps.count()
    return stops_and_trips(plausible_positions(gps, n_rows=n), n_rows=n).select("subid", "kind", "start_id", "end_id")


# over all fixes, so that SQL can say it: V, the first fix that can't be with this one; R, how far a window from here goes
_STOPS = f"""
WITH o AS (SELECT subid, processed_id, time, lat, lon, row_number() OVER w AS i, CASE WHEN time - lag(time) OVER w > INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS quiet, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM processed_gps WINDOW w AS (PARTITION BY subid ORDER BY time, processed_id)),
q AS (SELECT *, sum(quiet) OVER (PARTITION BY subid ORDER BY i) AS silences, sum(CASE WHEN quiet = 1 OR i = 1 OR {sql_haversine('plon', 'plat', 'lon', 'lat')} > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY subid ORDER BY i) AS island FROM o),
far AS (SELECT a.subid, a.i, min(b.i) AS v FROM q a JOIN q b ON a.subid = b.subid AND a.island = b.island AND b.i > a.i WHERE {sql_haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} > 50 GROUP BY a.subid, a.i),
r AS (SELECT q.*, min(coalesce(far.v, max_i + 1)) OVER (PARTITION BY q.subid ORDER BY q.i DESC) - 1 AS r FROM (SELECT *, max(i) OVER (PARTITION BY subid, island) AS max_i FROM q) q LEFT JOIN far ON q.subid = far.subid AND q.i = far.i),
m AS (SELECT * FROM (SELECT *, lag(r) OVER (PARTITION BY subid ORDER BY i) AS before FROM r) WHERE before IS NULL OR r > before),
s AS (SELECT m.subid, m.i AS a, m.r AS b, m.processed_id AS start_id, e.processed_id AS end_id, m.silences AS s0, e.silences AS s1 FROM m JOIN r e ON m.subid = e.subid AND e.i = m.r WHERE e.time - m.time >= INTERVAL 10 MINUTE),
t AS (SELECT *, lead(a) OVER w AS next_a, lead(start_id) OVER w AS next_id, lead(s0) OVER w AS next_s FROM s WINDOW w AS (PARTITION BY subid ORDER BY a))
SELECT subid, 'stop' AS kind, start_id, end_id FROM s UNION ALL SELECT subid, 'trip', end_id, next_id FROM t WHERE next_a > b AND next_s = s1
"""


@R.query("p5_all_fixes", _STOPS)
def p5_all_fixes(spark, d):
    return stops_and_trips(table(spark, d, "processed_gps")).select("subid", "kind", "start_id", "end_id")


@R.query("p5_visits")
def p5_visits(spark, d):
    gps = table(spark, d, "processed_gps")
    n = gps.count()
    return visits_of(materialize(stops_and_trips(plausible_positions(gps, n_rows=n), n_rows=n)))


_SESSIONS = """
WITH g AS (SELECT subid, processed_id, time, CASE WHEN time - lag(time) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS part FROM processed_gps WINDOW w AS (PARTITION BY subid ORDER BY time, processed_id)),
s AS (SELECT *, sum(part) OVER (PARTITION BY subid ORDER BY time, processed_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
"""


@R.query("p7_found", _SESSIONS + "SELECT subid, arg_min(processed_id, (time, processed_id)) AS start_id, arg_max(processed_id, (time, processed_id)) AS end_id FROM s GROUP BY subid, session")
def p7_found(spark, d):
    return sessions(table(spark, d, "processed_gps")).select("subid", "start_id", "end_id")


@R.query("p7_sessions", _SESSIONS + "SELECT subid, min(time) AS start_time, max(time) AS end_time, epoch(max(time)) - epoch(min(time)) AS duration_s, count(*) AS n_fixes FROM s GROUP BY subid, session")
def p7_sessions(spark, d):
    return sessions(table(spark, d, "processed_gps")).select("subid", "start_time", "end_time", "duration_s", F.col("n_events").alias("n_fixes"))
