"""Queries of clusters, reported places, matching and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import mobility as M
from ..operators import places as L
from ..operators.tests_of_means import paired_t, welch_t
from ..session import lookup_join, materialize
from .mobility import clustered, clustered_sql, rounded, stays, stays_sql, visits
from .registry import Registry, sql_haversine, table

R = Registry()

CENTROIDS = "cent AS (SELECT subid, cluster_id, median(lat) AS lat, median(lon) AS lon, sum(dwell_mins) AS total_dwell_mins, avg(dwell_mins) AS mean_dwell_mins, count(*) AS n_stays, count(DISTINCT CAST(start_time AS DATE)) AS n_days FROM clustered WHERE cluster_id > 0 GROUP BY subid, cluster_id)"
TRUTH = f"""spots AS (SELECT subid, lat, lon, row_number() OVER (PARTITION BY subid ORDER BY min(utc), lat, lon) AS i FROM locations GROUP BY subid, lat, lon),
le AS (SELECT a.subid, a.i AS a, b.i AS b FROM spots a JOIN spots b ON a.subid = b.subid AND {sql_haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 50),
lr(subid, a, b) AS (SELECT subid, a, b FROM le UNION SELECT lr.subid, lr.a, le.b FROM lr JOIN le ON lr.subid = le.subid AND lr.b = le.a),
lroot AS (SELECT subid, a AS i, min(b) AS root FROM lr GROUP BY ALL),
lid AS (SELECT subid, i, CAST(dense_rank() OVER (PARTITION BY subid ORDER BY root) AS INTEGER) AS location_id FROM lroot),
rep AS (SELECT *, CAST(utc = min(utc) OVER (PARTITION BY subid) AS INTEGER) AS intake FROM locations),
truth AS (SELECT rep.subid, location_id, median(rep.lat) AS lat, median(rep.lon) AS lon, count(*) AS n_reports, max(intake) AS intake, coalesce(string_agg(DISTINCT lower(type), ', ' ORDER BY lower(type)), '') AS types FROM rep JOIN spots USING (subid, lat, lon) JOIN lid USING (subid, i) GROUP BY rep.subid, location_id)"""
BOTH = f"WITH RECURSIVE {clustered_sql()}, {CENTROIDS}, {TRUTH}, e AS (SELECT c.subid, c.cluster_id, t.location_id, {sql_haversine('c.lon', 'c.lat', 't.lon', 't.lat')} AS m FROM cent c JOIN truth t USING (subid))"
_KEY = ["location_id"]
#: Tasks a core for windows that are clustered by medoids, so that heavy ones are spread.
WINDOW_TASKS = 8


def cent(spark, d):
    return materialize(L.centroids(clustered(spark, d)))


def truth(spark, d):
    return materialize(L.dedupe_locations(M.intake_flag(table(spark, d, "locations"))))


@R.query("l1_dbscan_50_2", f"WITH RECURSIVE {clustered_sql(50, 2)} SELECT stay_id, subid, cluster_id FROM clustered")
def l1(spark, d):
    return clustered(spark, d, 50, 2).select("stay_id", "subid", "cluster_id")


@R.query("l1_dbscan_50_3", f"WITH RECURSIVE {clustered_sql(50, 3)} SELECT stay_id, subid, cluster_id FROM clustered")
def l1_3(spark, d):
    return clustered(spark, d, 50, 3).select("stay_id", "subid", "cluster_id")


@R.query("l1_dbscan_10_4", f"WITH RECURSIVE {clustered_sql(10, 4)} SELECT stay_id, subid, cluster_id FROM clustered")
def l1_tight(spark, d):
    return clustered(spark, d, 10, 4).select("stay_id", "subid", "cluster_id")


@R.query("l1_dbscan_25_1", f"WITH RECURSIVE {clustered_sql(25, 1)} SELECT stay_id, subid, cluster_id FROM clustered")
def l1_single(spark, d):
    return clustered(spark, d, 25, 1).select("stay_id", "subid", "cluster_id")


@R.query("l2_medoids_by_silhouette")
def l2(spark, d):
    return L.medoid_clusters(stays(spark, d)).select("stay_id", "subid", "cluster_id_kmeans", "optimal_k")


@R.query("l3_medoids_with_fallback")
def l3(spark, d):
    return L.medoid_clusters(stays(spark, d), 2, 20, fallback=True).select("stay_id", "subid", "cluster_id_kmeans", "optimal_k")


@R.query("l4_cluster_summary", f"WITH RECURSIVE {clustered_sql()}, {CENTROIDS} SELECT subid, cluster_id, n_stays, n_days, round(total_dwell_mins, 4) AS total_dwell_mins, round(mean_dwell_mins, 4) AS mean_dwell_mins, round(lat, 9) AS lat, round(lon, 9) AS lon FROM cent")
def l4(spark, d):
    return rounded(L.centroids(clustered(spark, d)), total_dwell_mins=4, mean_dwell_mins=4, lat=9, lon=9)


@R.query("l4_subject_clusters", f"WITH RECURSIVE {clustered_sql()} SELECT subid, count(DISTINCT cluster_id) FILTER (WHERE cluster_id > 0) AS n_clusters, count(*) AS n_stays, count(*) FILTER (WHERE cluster_id = 0) AS n_noise, round(sum(dwell_mins), 4) AS total_dwell_mins FROM clustered GROUP BY subid")
def l4_subjects(spark, d):
    placed = F.when(F.col("cluster_id") > 0, F.col("cluster_id"))
    return clustered(spark, d).groupBy("subid").agg(F.countDistinct(placed).alias("n_clusters"), F.count("*").alias("n_stays"), F.count_if(F.col("cluster_id") == 0).alias("n_noise"), F.round(F.sum("dwell_mins"), 4).alias("total_dwell_mins"))


@R.query("l4b_routine_places", f"WITH RECURSIVE {clustered_sql()}, {CENTROIDS} SELECT subid, cluster_id FROM cent WHERE n_days >= 2 AND total_dwell_mins >= 60")
def l4b(spark, d):
    return L.routine(cent(spark, d), 2, 60.0).select("subid", "cluster_id")


@R.query("l5_deduped_locations", f"WITH RECURSIVE {TRUTH} SELECT subid, location_id, round(lat, 6) AS lat, round(lon, 6) AS lon, n_reports, intake, types FROM truth")
def l5(spark, d):
    return rounded(truth(spark, d), lat=6, lon=6)


@R.query("l6_seen_by_stays", f"WITH RECURSIVE {stays_sql(5)}, {TRUTH} SELECT t.subid, t.location_id FROM truth t WHERE EXISTS (SELECT 1 FROM stays s WHERE s.subid = t.subid AND {sql_haversine('s.lon', 's.lat', 't.lon', 't.lat')} <= 100)")
def l6(spark, d):
    return L.seen_locations(truth(spark, d), stays(spark, d), _KEY).select("subid", "location_id")


@R.query("l6_seen_by_fixes", f"WITH RECURSIVE {TRUTH} SELECT t.subid, t.location_id FROM truth t WHERE EXISTS (SELECT 1 FROM processed_gps s WHERE s.subid = t.subid AND {sql_haversine('s.lon', 's.lat', 't.lon', 't.lat')} <= 100)")
def l6_fixes(spark, d):
    return L.seen_locations(truth(spark, d), table(spark, d, "processed_gps"), _KEY).select("subid", "location_id")


@R.query("l6b_dwell_at_location", f"WITH RECURSIVE {stays_sql(5)}, {TRUTH}, n AS (SELECT t.subid, t.location_id, count(s.stay_id) AS n_stays, coalesce(sum(s.dwell_mins), 0) AS dwell FROM truth t LEFT JOIN stays s ON s.subid = t.subid AND {sql_haversine('s.lon', 's.lat', 't.lon', 't.lat')} <= 100 GROUP BY ALL) SELECT subid, location_id, n_stays, round(dwell, 4) AS dwell_mins, dwell >= 120 AS major FROM n")
def l6b(spark, d):
    return rounded(L.dwell_at(truth(spark, d), stays(spark, d), _KEY).select("subid", "location_id", "n_stays", "dwell_mins", "major"), dwell_mins=4)


_CAPTURE = """n AS (SELECT subid, np, nt, (SELECT count(DISTINCT cluster_id) FROM e WHERE e.subid = p.subid AND m <= {r}) AS mp, (SELECT count(DISTINCT location_id) FROM e WHERE e.subid = p.subid AND m <= {r}) AS mt FROM (SELECT subid, count(*) AS np FROM cent GROUP BY subid) p JOIN (SELECT subid, count(*) AS nt FROM truth GROUP BY subid) t USING (subid)),
cap AS (SELECT subid, np AS n_places, nt AS n_truth, mp / np AS precision, mt / nt AS recall, CASE WHEN mp + mt > 0 THEN 2 * (mp / np) * (mt / nt) / (mp / np + mt / nt) ELSE 0 END AS f1 FROM n)"""


@R.query("l7_capture", f"{BOTH}, {_CAPTURE.format(r=100)} SELECT subid, n_places, n_truth, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM cap")
def l7(spark, d):
    t = L.capture(cent(spark, d), truth(spark, d))
    return rounded(t.select("subid", "n_places", "n_truth", "precision", "recall", "f1"), precision=6, recall=6, f1=6)


@R.query("l8_one_to_one_match")
def l8(spark, d):
    t = L.capture(cent(spark, d), truth(spark, d), one_to_one=True)
    return t.select("subid", "n_places", "n_truth", F.col("matched_places").alias("n_matched"), "precision", "recall", "f1")


def _grid(spark, d):
    per_dwell = {float(x): materialize(stays(spark, d, x)) for x in (2, 5, 10, 15)}
    return L.grid_search(per_dwell, truth(spark, d), [25, 50, 75, 100], [2, 3, 4, 5])


@R.query("l9_grid_search")
def l9(spark, d):
    g = _grid(spark, d).groupBy("dwell_threshold", "eps_meters", "min_pts")
    return g.agg(F.count("*").alias("n_subjects"), *(F.round(f(c), 3).alias(f"{n}_{c}") for c in ("precision", "recall", "f1") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))))


@R.query("l9_grid_cell", f"{BOTH}, {_CAPTURE.format(r=100)} SELECT count(*) AS n_subjects, round(avg(precision), 5) AS mean_precision, round(avg(recall), 5) AS mean_recall FROM cap")
def l9_cell(spark, d):
    g = L.grid_search({5.0: stays(spark, d)}, truth(spark, d), [50], [2])
    return g.agg(F.count("*").alias("n_subjects"), F.round(F.avg("precision"), 5).alias("mean_precision"), F.round(F.avg("recall"), 5).alias("mean_recall"))


@R.query("l9b_nearest_against_one_to_one")
def l9b(spark, d):
    a, t = cent(spark, d), truth(spark, d)
    nn, one = (L.capture(a, t, one_to_one=x).select("subid", F.col("recall").alias(f"recall_{n}"), F.col("precision").alias(f"precision_{n}")) for x, n in ((False, "nn"), (True, "one")))
    j = nn.join(one, "subid").withColumns({"d_recall": F.col("recall_nn") - F.col("recall_one"), "d_precision": F.col("precision_nn") - F.col("precision_one")})
    return j.agg(F.count("*").alias("n"), *(F.round(f(c), 4).alias(f"{k}_{c}") for c in ("d_recall", "d_precision") for k, f in (("mean", F.avg), ("max", F.max), ("min", F.min))))


_THRESHOLDS = list(range(50, 251, 25))


@R.query("l9c_threshold_sensitivity", f"{BOTH}, th AS (SELECT unnest(range(50, 251, 25)) AS r), s AS (SELECT th.r, t.subid, (SELECT count(DISTINCT location_id) FROM e WHERE e.subid = t.subid AND e.m <= th.r) / nt AS recall FROM th, (SELECT subid, count(*) AS nt FROM truth WHERE subid IN (SELECT subid FROM cent) GROUP BY subid) t) SELECT CAST(r AS INTEGER) AS threshold_m, count(*) AS n_subjects, round(avg(recall), 5) AS mean_recall FROM s GROUP BY r")
def l9c(spark, d):
    a, t = cent(spark, d), truth(spark, d)
    edges = materialize(L.near_edges(a, t, max(_THRESHOLDS)))
    n = t.join(a.select("subid").distinct(), "subid", "left_semi").groupBy("subid").agg(F.count("*").alias("nt"))
    hits = edges.groupBy("subid").agg(*(F.countDistinct(F.when(F.col("dist_m") <= r, F.col("location_id"))).alias(f"h{r}") for r in _THRESHOLDS))
    j = n.join(hits, "subid", "left").fillna(0)
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("threshold_m"), (F.col(f"h{r}") / F.col("nt")).alias("recall")) for r in _THRESHOLDS)))
    return j.select(each.alias("x")).groupBy("x.threshold_m").agg(F.count("*").alias("n_subjects"), F.round(F.avg("x.recall"), 5).alias("mean_recall"))


@R.query("l10_window_comparison")
def l10(spark, d):
    """Per (subject, window of whole days) with at least three stays: how density clusters, routine ones and medoids capture the known places."""
    w = M.cumulative_windows(materialize(stays(spark, d)), 1)
    by = ["subid", "window_days"]
    enough = materialize(w.groupBy(*by).agg(F.count("*").alias("n_stays")).filter("n_stays >= 3"))
    w = materialize(w.join(enough.select(*by), by, "left_semi").select(*by, "stay_id", "start_time", "dwell_mins", "lat", "lon"))
    # a window is much work in few bytes, so the number of tasks doesn't follow the bytes
    w = w.repartition(WINDOW_TASKS * spark.sparkContext.defaultParallelism, *by)
    known = truth(spark, d)
    dense = materialize(L.centroids(L.cluster_stays(w, 50.0, 3, by), by))
    medoid = materialize(L.centroids(L.medoid_clusters(w, 2, 20, True, by), by, "cluster_id_kmeans").withColumnRenamed("cluster_id_kmeans", "cluster_id"))
    kinds = {"dbscan": dense, "routine": L.routine(dense, 2), "kmeans": medoid}
    scores = [L.capture(p, known, by=by).select(*by, F.col("n_places").alias(f"{k}_clusters"), *(F.col(c).alias(f"{k}_{c}") for c in ("recall", "precision", "f1"))) for k, p in kinds.items()]
    return reduce(lambda a, b: a.join(b, by, "left"), scores, enough)


@R.query("l10_days_to_recall")
def l10_days(spark, d):
    t = l10(spark, d)
    return t.groupBy("subid").agg(F.max("window_days").alias("last_window"), F.min(F.when(F.col("dbscan_recall") >= 0.8, F.col("window_days"))).alias("days_to_80"))


_QUALIFY = "n_days >= 2 AND total_dwell_mins > 20"


@R.query("l11_criterion", f"{BOTH}, q AS (SELECT * FROM cent WHERE {_QUALIFY}), missed AS (SELECT q.subid, count(*) AS n FROM q WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.subid = q.subid AND e.cluster_id = q.cluster_id AND e.m <= 100) GROUP BY q.subid), near AS (SELECT t.subid, t.location_id, count(DISTINCT CAST(s.start_time AS DATE)) AS days, sum(s.dwell_mins) AS mins FROM truth t JOIN stays s ON s.subid = t.subid AND {sql_haversine('s.lon', 's.lat', 't.lon', 't.lat')} <= 100 WHERE t.intake = 0 GROUP BY ALL) SELECT c.subid, count(*) AS n_clusters, count(*) FILTER (WHERE {_QUALIFY}) AS n_qualifying, (SELECT count(*) FROM truth t WHERE t.subid = c.subid AND intake = 0) AS n_locations, (SELECT count(*) FROM near WHERE near.subid = c.subid AND days >= 2 AND mins > 20) AS n_locations_qualifying, coalesce((SELECT n FROM missed WHERE missed.subid = c.subid), 0) AS n_missed FROM cent c GROUP BY c.subid")
def l11(spark, d):
    """Which clusters, and which places known later than at intake, are visited often and long enough; clusters near no known place are missed."""
    s = stays(spark, d)
    c, t = cent(spark, d), truth(spark, d)
    q = c.filter(_QUALIFY)
    missed = q.join(L.near_edges(q, t, 100.0).select("subid", "cluster_id").distinct(), ["subid", "cluster_id"], "left_anti").groupBy("subid").agg(F.count("*").alias("n_missed"))
    later = t.filter("intake = 0")
    visits_near = L.near_edges(s.select("subid", "stay_id", "start_time", "dwell_mins", "lat", "lon").withColumnRenamed("stay_id", "cluster_id"), later, 100.0).withColumnRenamed("cluster_id", "stay_id").join(s.select("subid", "stay_id", "start_time", "dwell_mins"), ["subid", "stay_id"])
    fit = visits_near.groupBy("subid", "location_id").agg(F.countDistinct(F.to_date("start_time")).alias("days"), F.sum("dwell_mins").alias("mins")).filter("days >= 2 AND mins > 20").groupBy("subid").agg(F.count("*").alias("n_locations_qualifying"))
    base = c.groupBy("subid").agg(F.count("*").alias("n_clusters"), F.count_if(F.expr(_QUALIFY)).alias("n_qualifying"))
    return base.join(later.groupBy("subid").agg(F.count("*").alias("n_locations")), "subid", "left").join(fit, "subid", "left").join(missed, "subid", "left").fillna(0)


@R.query("l12_concordance")
def l12(spark, d):
    """Clusters up to each follow-up against the places known by then, for several parameters."""
    by = ["subid", "fu_number", "min_pts"]
    w = M.visit_windows(stays(spark, d), visits(spark, d)).withColumn("min_pts", F.explode(F.array(F.lit(2), F.lit(3))))
    parts = [L.centroids(L.cluster_stays(w.filter(F.col("min_pts") == m), 50.0, m, by), by) for m in (2, 3)]
    places = materialize(parts[0].unionByName(parts[1]))
    ends = visits(spark, d).filter(~F.col("visit_type").contains("intake")).select("subid", F.col("visit_date").alias("window_end")).distinct()
    ends = L.rank_by_subject(ends, ["window_end"], "fu_number").filter("fu_number <= 3")
    known = lookup_join(M.intake_flag(table(spark, d, "locations")), ends, ["subid"], spread="utc")
    legacy = known.filter(M.known_by(known, F.col("window_end")))
    spots = L.dedupe_locations(M.intake_flag(table(spark, d, "locations")))
    seen = L.near_edges(legacy.withColumn("cluster_id", F.xxhash64("utc", "lat", "lon")).select("subid", "fu_number", "cluster_id", "lat", "lon"), spots.join(ends.select("subid", "fu_number"), "subid"), 50.0, ["subid", "fu_number"]).select("subid", "fu_number", "location_id").distinct()
    truth_then = spots.join(seen, ["subid", "location_id"]).withColumn("min_pts", F.explode(F.array(F.lit(2), F.lit(3))))
    return L.concordance(places, materialize(truth_then), by)


_SIL = f"""WITH RECURSIVE {clustered_sql()}, x AS (SELECT * FROM clustered WHERE cluster_id > 0), pr AS (SELECT a.subid, a.stay_id, a.cluster_id AS ca, b.cluster_id AS cb, sum({sql_haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')}) AS s, count(*) AS n FROM x a JOIN x b USING (subid) GROUP BY ALL),
ab AS (SELECT subid, stay_id, max(CASE WHEN ca = cb AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN ca <> cb THEN s / n END) AS b FROM pr GROUP BY ALL)"""


@R.query("l13_silhouette", f"{_SIL} SELECT ab.subid, (SELECT count(DISTINCT cluster_id) FROM x WHERE x.subid = ab.subid) AS n_clusters, round(CASE WHEN count(b) > 0 THEN avg(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END) END, 5) AS silhouette FROM ab GROUP BY ab.subid")
def l13(spark, d):
    return rounded(L.silhouettes(clustered(spark, d)), silhouette=5)


@R.query("l14_mean_pair_distance", f"WITH RECURSIVE {clustered_sql()} SELECT a.subid, a.cluster_id, CAST(sqrt(count(*)) AS BIGINT) AS n, round(CASE WHEN count(*) > 1 THEN sum({sql_haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')}) / (count(*) - sqrt(count(*))) ELSE 0 END, 3) AS mean_pair_m FROM clustered a JOIN clustered b ON a.subid = b.subid AND a.cluster_id = b.cluster_id WHERE a.cluster_id > 0 GROUP BY ALL")
def l14(spark, d):
    return rounded(L.spread_within(clustered(spark, d)), mean_pair_m=3)


@R.query("l15_noise_share", f"WITH RECURSIVE {clustered_sql(50, 3)} SELECT subid, count(*) AS n_stays, count(*) FILTER (WHERE cluster_id = 0) AS n_noise, round(100.0::DOUBLE * count(*) FILTER (WHERE cluster_id = 0) / count(*), 4) AS noise_pct FROM clustered GROUP BY subid")
def l15(spark, d):
    n = F.count_if(F.col("cluster_id") == 0)
    return clustered(spark, d, 50, 3).groupBy("subid").agg(F.count("*").alias("n_stays"), n.alias("n_noise"), F.round(100.0 * n / F.count("*"), 4).alias("noise_pct"))


@R.query("l15_outliers", f"WITH RECURSIVE {clustered_sql()}, {CENTROIDS}, o AS (SELECT c.subid, c.cluster_id, c.stay_id, {sql_haversine('c.lon', 'c.lat', 't.lon', 't.lat')} AS m FROM clustered c JOIN cent t USING (subid, cluster_id)), s AS (SELECT *, avg(m) OVER w AS a, stddev_samp(m) OVER w AS sd FROM o WINDOW w AS (PARTITION BY subid, cluster_id)) SELECT stay_id, round(m, 3) AS dist_m, coalesce(m > a + 2 * sd, false) AS outlier FROM s")
def l15_outliers(spark, d):
    c = clustered(spark, d)
    return rounded(L.outliers(c, L.centroids(c)).select("stay_id", "dist_m", "outlier"), dist_m=3)


@R.query("l16_home_share", f"WITH RECURSIVE {clustered_sql()}, {CENTROIDS} SELECT subid, cluster_id, round(100.0::DOUBLE * total_dwell_mins / s, 4) AS home_pct FROM (SELECT *, sum(total_dwell_mins) OVER (PARTITION BY subid) AS s, rank() OVER (PARTITION BY subid ORDER BY total_dwell_mins DESC) AS r FROM cent) WHERE r = 1")
def l16(spark, d):
    return rounded(L.home_share(cent(spark, d)).select("subid", "cluster_id", "home_pct"), home_pct=4)


_EVIDENCE = f"WITH RECURSIVE {stays_sql(5)}, {TRUTH}, n AS (SELECT t.subid, t.location_id, t.types, min(m) FILTER (WHERE m <= 500) AS nearest, count(*) FILTER (WHERE m <= 50) AS n_50, count(*) FILTER (WHERE m <= 100) AS n_100, coalesce(sum(dwell_mins) FILTER (WHERE m <= 100), 0) AS dwell FROM truth t LEFT JOIN (SELECT t.subid, t.location_id, s.dwell_mins, {sql_haversine('s.lon', 's.lat', 't.lon', 't.lat')} AS m FROM truth t JOIN stays s USING (subid)) x ON t.subid = x.subid AND t.location_id = x.location_id GROUP BY ALL)"


@R.query("l17_nearest_stay_evidence", f"{_EVIDENCE} SELECT subid, location_id, round(nearest, 2) AS nearest_m, n_50, n_100, round(dwell, 4) AS dwell_100, CASE WHEN nearest <= 50 THEN 'within 50 m' WHEN nearest <= 100 THEN 'within 100 m' WHEN nearest <= 500 THEN 'within 500 m' ELSE 'none' END AS evidence FROM n")
def l17(spark, d):
    t = L.nearest_stay(truth(spark, d), stays(spark, d), _KEY)
    return rounded(t.select("subid", "location_id", "nearest_m", "n_50", "n_100", "dwell_100", "evidence"), nearest_m=2, dwell_100=4)


@R.query("l17_found_by_type", f"{_EVIDENCE} SELECT types, count(*) AS n, count(*) FILTER (WHERE n_100 > 0) AS n_found, round(100.0::DOUBLE * count(*) FILTER (WHERE n_100 > 0) / count(*), 3) AS pct_found FROM n GROUP BY types")
def l17_types(spark, d):
    found = F.count_if(F.col("n_100") > 0)
    return L.nearest_stay(truth(spark, d), stays(spark, d), _KEY).groupBy("types").agg(F.count("*").alias("n"), found.alias("n_found"), F.round(100.0 * found / F.count("*"), 3).alias("pct_found"))


@R.query("l18_fragmentation", f"{BOTH}, {_CAPTURE.format(r=100)} SELECT subid, round(n_places / n_truth, 5) AS ratio, n_places > 2 * n_truth AS fragmented, recall < 0.3 AS low_recall FROM cap")
def l18(spark, d):
    t = L.capture(cent(spark, d), truth(spark, d))
    return t.select("subid", F.round(F.col("n_places") / F.col("n_truth"), 5).alias("ratio"), (F.col("n_places") > 2 * F.col("n_truth")).alias("fragmented"), (F.col("recall") < 0.3).alias("low_recall"))


# --- statistics

_HALVES = "SELECT subid, avg(speed_mph) FILTER (WHERE hour(time) < 12) AS x, avg(speed_mph) FILTER (WHERE hour(time) >= 12) AS y FROM processed_gps WHERE speed_mph BETWEEN 0 AND 100 GROUP BY subid"


def _halves(spark, d):
    v, early = F.col("speed_mph"), F.hour("time") < 12
    return table(spark, d, "processed_gps").filter(v.between(0, 100)).groupBy("subid").agg(F.avg(F.when(early, v)).alias("x"), F.avg(F.when(~early, v)).alias("y"))


@R.query("x1_paired_t", f"WITH h AS ({_HALVES}) SELECT count(x - y) AS n, round(avg(x - y), 6) AS mean_diff, round(avg(x - y) / (stddev_samp(x - y) / sqrt(count(x - y))), 5) AS t, CAST(count(x - y) - 1 AS DOUBLE) AS df FROM h")
def x1(spark, d):
    return paired_t(_halves(spark, d), "x", "y").select(F.col("n_x").alias("n"), F.round("mean_diff", 6).alias("mean_diff"), F.round("t", 5).alias("t"), "df")


@R.query("x1_paired_t_p_value")
def x1_p(spark, d):
    return paired_t(_halves(spark, d), "x", "y")


@R.query("x2_welch_t", "WITH s AS (SELECT count(v) FILTER (WHERE e) AS n1, count(v) FILTER (WHERE NOT e) AS n2, avg(v) FILTER (WHERE e) AS m1, avg(v) FILTER (WHERE NOT e) AS m2, var_samp(v) FILTER (WHERE e) AS v1, var_samp(v) FILTER (WHERE NOT e) AS v2 FROM (SELECT speed_mph AS v, hour(time) < 12 AS e FROM processed_gps WHERE speed_mph BETWEEN 0 AND 100)) SELECT n1 AS n_x, n2 AS n_y, round(m1 - m2, 6) AS mean_diff, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) AS t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 2) AS df FROM s")
def x2(spark, d):
    t = welch_t(table(spark, d, "processed_gps").filter(F.col("speed_mph").between(0, 100)), "speed_mph", F.hour("time") < 12)
    return t.select("n_x", "n_y", F.round("mean_diff", 6).alias("mean_diff"), F.round("t", 4).alias("t"), F.round("df", 2).alias("df"))


@R.query("x2_welch_t_p_value")
def x2_p(spark, d):
    return welch_t(table(spark, d, "processed_gps").filter(F.col("speed_mph").between(0, 100)), "speed_mph", F.hour("time") < 12)


@R.query("x3_histogram", "SELECT CAST(floor(speed_mph / 5) AS BIGINT) AS bin, count(*) AS n FROM processed_gps WHERE speed_mph >= 0 AND speed_mph < 100 GROUP BY 1")
def x3(spark, d):
    return table(spark, d, "processed_gps").filter("speed_mph >= 0 AND speed_mph < 100").groupBy(F.floor(F.col("speed_mph") / 5).alias("bin")).agg(F.count("*").alias("n"))
