"""Queries of the trajectory operators: pings to steps, stays, windows and entropy features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mobility as M
from ..operators import relational as rel
from ..operators.places import cluster_stays
from ..session import materialize
from .registry import Registry, sql_haversine, table

R = Registry()

_VALID = "SELECT * FROM raw_gps WHERE subid IS NOT NULL AND time IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180"
STEPS = f"""
l AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(time) OVER w AS ptime FROM ({_VALID}) WINDOW w AS (PARTITION BY subid ORDER BY time, point_id)),
s0 AS (SELECT *, CASE WHEN ptime IS NULL THEN 0 ELSE {sql_haversine('plon', 'plat', 'lon', 'lat')} END AS dist_m, CASE WHEN ptime IS NULL THEN 0 ELSE (epoch_us(time) - epoch_us(ptime)) / 6e7 END AS duration_min FROM l),
steps AS (SELECT *, dist_m / 1609.344 AS dist_miles, CASE WHEN duration_min > 0 THEN dist_m / 1609.344 / (duration_min / 60) ELSE 0 END AS speed_mph FROM s0)"""
PROCESSED = STEPS + """,
good AS (SELECT * FROM steps WHERE NOT (dist_miles > 0.01 AND duration_min = 0) AND NOT speed_mph > 100 AND NOT (duration_min > 0.5 AND dist_miles > 0.31)),
proc AS (SELECT *, timezone('America/Chicago', timezone('UTC', time)) AS time_local FROM good)"""
RAW_STAYS = PROCESSED + f""",
f AS (SELECT *, lag(lat) OVER w AS qlat, lag(lon) OVER w AS qlon, lag(time_local) OVER w AS qtime FROM proc WINDOW w AS (PARTITION BY subid ORDER BY time, point_id)),
g AS (SELECT *, CASE WHEN qtime IS NULL OR {sql_haversine('qlon', 'qlat', 'lon', 'lat')} > 50 OR (epoch_us(time_local) - epoch_us(qtime)) / 6e7 > 60 THEN 1 ELSE 0 END AS new FROM f),
h AS (SELECT *, sum(new) OVER (PARTITION BY subid ORDER BY time, point_id ROWS UNBOUNDED PRECEDING) AS stay FROM g),
raw_stays AS (SELECT subid, stay, min(time_local) AS start_time, max(time_local) AS end_time, (epoch_us(max(time_local)) - epoch_us(min(time_local))) / 6e7 AS dwell_mins, count(*) AS n_points, median(lat) AS lat, median(lon) AS lon FROM h GROUP BY subid, stay)"""


def stays_sql(least: float = 5) -> str:
    return RAW_STAYS + f", stays AS (SELECT CAST(row_number() OVER (ORDER BY subid, stay) AS INTEGER) AS stay_id, * EXCLUDE (stay) FROM raw_stays WHERE dwell_mins BETWEEN {least} AND 720)"


def clustered_sql(eps: float = 50, min_pts: int = 2, least: float = 5) -> str:
    """Stays with cluster_id: neighbour pairs, core stays, components by recursion, border stays to the lowest cluster."""
    return stays_sql(least) + f""",
nb AS (SELECT a.subid, a.stay_id AS a, b.stay_id AS b FROM stays a JOIN stays b ON a.subid = b.subid AND {sql_haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= {eps}),
core AS (SELECT subid, a FROM nb GROUP BY subid, a HAVING count(*) >= {min_pts}),
ce AS (SELECT nb.* FROM nb JOIN core x ON nb.a = x.a JOIN core y ON nb.b = y.a),
reach(a, b) AS (SELECT a, b FROM ce UNION SELECT reach.a, ce.b FROM reach JOIN ce ON reach.b = ce.a),
root AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
num AS (SELECT subid, root.a, dense_rank() OVER (PARTITION BY subid ORDER BY root) AS k FROM root JOIN core USING (a)),
border AS (SELECT nb.a, min(num.k) AS k FROM nb JOIN num ON nb.b = num.a WHERE nb.a NOT IN (SELECT a FROM core) GROUP BY nb.a),
size AS (SELECT subid, count(*) AS n FROM stays GROUP BY subid),
clustered AS (SELECT s.*, CAST(CASE WHEN size.n < 2 THEN 1 ELSE coalesce(num.k, border.k, 0) END AS INTEGER) AS cluster_id FROM stays s JOIN size USING (subid) LEFT JOIN num ON s.stay_id = num.a LEFT JOIN border ON s.stay_id = border.a)"""


def raw(spark, d):
    return table(spark, d, "raw_gps")


def stays(spark, d, least: float = 5):
    return M.detect_stays(M.process(raw(spark, d)), "point_id", time_min=least)


def clustered(spark, d, eps: float = 50, min_pts: int = 2, least: float = 5):
    return materialize(cluster_stays(stays(spark, d, least), eps, min_pts))


def rounded(df, **digits):
    return df.withColumns({c: F.round(c, k) for c, k in digits.items()})


@R.query("k1_localise", "SELECT point_id, time, timezone('America/Chicago', timezone('UTC', time)) AS time_local FROM raw_gps")
def k1(spark, d):
    return M.localise(raw(spark, d)).select("point_id", "time", "time_local")


@R.query("k2_step_metrics", f"WITH {STEPS} SELECT point_id, round(dist_m, 3) AS dist_m, round(dist_miles, 6) AS dist_miles, round(duration_min, 6) AS duration_min, round(speed_mph, 5) AS speed_mph FROM steps")
def k2(spark, d):
    s = M.step_metrics(M.valid_fixes(raw(spark, d)))
    return rounded(s.select("point_id", "dist_m", "dist_miles", "duration_min", "speed_mph"), dist_m=3, dist_miles=6, duration_min=6, speed_mph=5)


@R.query("k3_quality_filter", f"WITH {PROCESSED} SELECT point_id, subid, round(speed_mph, 4) AS speed_mph FROM good")
def k3(spark, d):
    return rounded(M.quality_filter(M.step_metrics(M.valid_fixes(raw(spark, d)))).select("point_id", "subid", "speed_mph"), speed_mph=4)


@R.query("k3_quality_filter_short_gap", f"WITH {STEPS} SELECT point_id FROM steps WHERE NOT (dist_miles > 0.01 AND duration_min = 0) AND NOT speed_mph > 100 AND NOT (duration_min < 0.5 AND dist_miles > 0.31)")
def k3_prose(spark, d):
    return M.quality_filter(M.step_metrics(M.valid_fixes(raw(spark, d))), "short_gap").select("point_id")


@R.query("k3b_filter_impact", f"WITH {PROCESSED}, n AS (SELECT (SELECT count(*) FROM steps) AS a, (SELECT count(*) FROM good) AS b) SELECT 'before' AS metric, a AS n, 100.0::DOUBLE AS pct FROM n UNION ALL SELECT 'after', b, round(100.0::DOUBLE * b / a, 2) FROM n UNION ALL SELECT 'removed', a - b, round(100.0::DOUBLE * (a - b) / a, 2) FROM n")
def k3b(spark, d):
    steps = materialize(M.step_metrics(M.valid_fixes(raw(spark, d))))
    return M.filter_impact(steps, M.quality_filter(steps))


@R.query("k4_movement_class", f"WITH {PROCESSED} SELECT point_id, speed_mph <= 4 AS is_stationary, CASE WHEN speed_mph <= 4 THEN 'stationary' ELSE 'transition' END AS movement_state, CAST(round(duration_min * 60) AS INTEGER) AS dwell_time_seconds, round(dist_miles, 4) AS dist_miles, round(speed_mph, 2) AS speed_mph FROM proc")
def k4(spark, d):
    return M.process(raw(spark, d)).select("point_id", "is_stationary", "movement_state", "dwell_time_seconds", "dist_miles", "speed_mph")


_STAY_COLUMNS = "stay_id, subid, start_time, end_time, round(dwell_mins, 6) AS dwell_mins, n_points, round(lat, 7) AS lat, round(lon, 7) AS lon"


@R.query("k5_detect_stays", f"WITH {stays_sql(10)} SELECT {_STAY_COLUMNS} FROM stays")
def k5(spark, d):
    return rounded(stays(spark, d, 10), dwell_mins=6, lat=7, lon=7)


@R.query("k5_detect_stays_5_min", f"WITH {stays_sql(5)} SELECT {_STAY_COLUMNS} FROM stays")
def k5_5(spark, d):
    return rounded(stays(spark, d, 5), dwell_mins=6, lat=7, lon=7)


@R.query("k5b_stay_diagnostics", f"WITH {RAW_STAYS}, k AS (SELECT * FROM raw_stays WHERE dwell_mins BETWEEN 10 AND 720) SELECT (SELECT count(*) FROM proc) AS n_points, (SELECT count(*) FROM raw_stays) AS n_raw, (SELECT count(*) FROM raw_stays WHERE dwell_mins < 10) AS too_short, (SELECT count(*) FROM raw_stays WHERE dwell_mins > 720) AS too_long, (SELECT count(*) FROM k) AS kept, round(100.0::DOUBLE * (SELECT sum(n_points) FROM k) / (SELECT count(*) FROM proc), 3) AS pct_points, round((SELECT median(dwell_mins) FROM k), 4) AS median_dwell, round((SELECT avg(n_points) FROM k), 4) AS mean_points")
def k5b(spark, d):
    fixes = materialize(M.process(raw(spark, d)))
    all_points = fixes.agg(F.count("*").alias("n_points"))
    kept = F.col("dwell_mins").between(10, 720)
    s = M.raw_stays(fixes, "point_id").withColumn("dwell_mins", (F.col("end_us") - F.col("start_us")) / 6e7)
    t = s.agg(F.count("*").alias("n_raw"), F.count_if(F.col("dwell_mins") < 10).alias("too_short"), F.count_if(F.col("dwell_mins") > 720).alias("too_long"), F.count_if(kept).alias("kept"), F.sum(F.when(kept, F.col("n_points"))).alias("p"), F.round(F.median(F.when(kept, F.col("dwell_mins"))), 4).alias("median_dwell"), F.round(F.avg(F.when(kept, F.col("n_points"))), 4).alias("mean_points"))
    return all_points.crossJoin(t).withColumn("pct_points", F.round(100.0 * F.col("p") / F.col("n_points"), 3)).drop("p")


@R.query("k5b_subject_stays", f"WITH {stays_sql(10)} SELECT subid, count(*) AS n_stays, round(sum(dwell_mins), 4) AS total_dwell_mins, round(median(dwell_mins), 4) AS median_dwell_mins, CAST(sum(n_points) AS BIGINT) AS total_points, round(max(dwell_mins), 4) AS longest FROM stays GROUP BY subid")
def k5b_subjects(spark, d):
    t = stays(spark, d, 10).groupBy("subid").agg(F.count("*").alias("n_stays"), F.sum("dwell_mins").alias("total_dwell_mins"), F.median("dwell_mins").alias("median_dwell_mins"), F.sum("n_points").alias("total_points"), F.max("dwell_mins").alias("longest"))
    return rounded(t, total_dwell_mins=4, median_dwell_mins=4, longest=4)


_GAPS = f"""WITH {STEPS}, gaps AS (SELECT coalesce(app_source, 'none') AS app, CASE WHEN dist_m <= 50 THEN 'Stationary' ELSE 'Moving' END AS movement, duration_min * 60 AS gap_s FROM steps WHERE duration_min > 0),
by_state AS (SELECT app, movement, count(*) FILTER (WHERE gap_s < 3600) AS n_points, min(gap_s) FILTER (WHERE gap_s < 3600) AS min_gap, quantile_cont(gap_s, 0.25) FILTER (WHERE gap_s < 3600) AS q25, median(gap_s) FILTER (WHERE gap_s < 3600) AS median_gap, quantile_cont(gap_s, 0.75) FILTER (WHERE gap_s < 3600) AS q75, max(gap_s) FILTER (WHERE gap_s < 3600) AS max_gap, avg(gap_s) FILTER (WHERE gap_s < 3600) AS mean_gap, count(*) FILTER (WHERE gap_s >= 3600) AS n_excluded, quantile_cont(gap_s, 0.95) AS q95_all, quantile_cont(gap_s, 0.99) AS q99_all FROM gaps GROUP BY ALL)"""
_NUMBERS = ("min_gap", "q25", "median_gap", "q75", "max_gap", "mean_gap", "q95_all", "q99_all")


def _sampling(spark, d):
    return M.sampling_by_movement(M.valid_fixes(raw(spark, d)).fillna("none", ["app_source"]))


@R.query("k6_gaps_by_movement", f"{_GAPS} SELECT app, movement, n_points, n_excluded, {', '.join(f'round({c}, 3) AS {c}' for c in _NUMBERS)} FROM by_state")
def k6(spark, d):
    return rounded(_sampling(spark, d)[0], **dict.fromkeys(_NUMBERS, 3))


@R.query("k6_adaptive_sampling", f"{_GAPS}, w AS (SELECT app, max(median_gap) FILTER (WHERE movement = 'Stationary') AS stationary, max(median_gap) FILTER (WHERE movement = 'Moving') AS moving FROM by_state GROUP BY app) SELECT app, round(stationary, 3) AS stationary, round(moving, 3) AS moving, round(stationary / moving, 5) AS ratio, CASE WHEN stationary / moving > 1.5 THEN 'likely adaptive sampling' WHEN stationary / moving IS NOT NULL THEN 'likely fixed-interval sampling' END AS sampling FROM w")
def k6_ratio(spark, d):
    return rounded(_sampling(spark, d)[1], stationary=3, moving=3, ratio=5)


_WINDOWS = """, span AS (SELECT subid, min(start_time) AS t0, (epoch_us(max(start_time)) - epoch_us(min(start_time))) / 86400e6 + 1 AS days FROM stays GROUP BY subid),
win AS (SELECT subid, t0, unnest(range(1, CAST(floor(days) AS BIGINT) + 1, 1)) AS window_days FROM span WHERE days >= 1)"""


@R.query("k7_cumulative_windows", f"WITH {stays_sql(5)}{_WINDOWS} SELECT s.stay_id, w.window_days::INTEGER AS window_days, round((epoch_us(s.start_time) - epoch_us(w.t0)) / 86400e6 + 1, 5) AS study_day FROM stays s JOIN win w USING (subid) WHERE (epoch_us(s.start_time) - epoch_us(w.t0)) / 86400e6 + 1 <= w.window_days")
def k7(spark, d):
    return rounded(M.cumulative_windows(stays(spark, d), 1).select("stay_id", "window_days", "study_day"), study_day=5)


_VISITS = "visits AS (SELECT subid, 'intake' AS visit_type, study_start AS visit_date FROM study_dates_gps UNION ALL SELECT subid, 'followup_' || k, CAST(study_start + CAST(k AS INTEGER) AS DATE) FROM study_dates_gps, (VALUES (1), (2), (4), (7)) v(k))"


def visits(spark, d):
    """Visits of a study: intake at its start, follow-ups some days later, as one row a visit."""
    t = table(spark, d, "study_dates_gps").select("subid", F.col("study_start").alias("intake"), *(F.date_add("study_start", k).alias(f"followup_{k}") for k in (1, 2, 4, 7)))
    return t.unpivot("subid", t.columns[1:], "visit_type", "visit_date")


@R.query("k7b_follow_up_windows", f"WITH {stays_sql(5)}, {_VISITS}, fu AS (SELECT subid, visit_date, row_number() OVER (PARTITION BY subid ORDER BY visit_date) AS fu_number FROM visits WHERE NOT contains(visit_type, 'intake')) SELECT s.stay_id, fu.fu_number, CAST(fu.visit_date AS VARCHAR) AS window_end FROM stays s JOIN fu USING (subid) WHERE fu_number <= 3 AND CAST(s.start_time AS DATE) <= fu.visit_date")
def k7b(spark, d):
    return M.visit_windows(stays(spark, d), visits(spark, d)).select("stay_id", F.col("fu_number").cast("long").alias("fu_number"), F.col("window_end").cast("string"))


@R.query("k8_daily_entropy", f"WITH RECURSIVE {clustered_sql()}, e AS (SELECT subid, CAST(start_time AS DATE) AS date, count(*) AS n_stays, count(DISTINCT cluster_id) FILTER (WHERE cluster_id > 0) AS n_clusters, sum(dwell_mins) AS total, ln(sum(dwell_mins) FILTER (WHERE cluster_id > 0)) - sum(dwell_mins * ln(dwell_mins)) FILTER (WHERE cluster_id > 0) / sum(dwell_mins) FILTER (WHERE cluster_id > 0) AS h FROM clustered GROUP BY ALL) SELECT subid, CAST(date AS VARCHAR) AS date, n_stays, n_clusters, round(total, 4) AS total_dwell_mins, round(h, 6) AS location_entropy, round(h / ln(n_clusters), 6) AS normalized_entropy FROM e WHERE n_stays >= 3 AND n_clusters >= 2")
def k8(spark, d):
    t = M.daily_entropy(clustered(spark, d)).withColumn("date", F.col("date").cast("string"))
    return rounded(t, total_dwell_mins=4, location_entropy=6, normalized_entropy=6)


_PER_DAY = ", per_day AS (SELECT subid, CAST(start_time AS DATE) AS date, count(*) AS n_stays, sum(dwell_mins) AS dwell FROM stays GROUP BY ALL)"


def _per_day(spark, d):
    return stays(spark, d).groupBy("subid", F.to_date("start_time").alias("date")).agg(F.count("*").alias("n_stays"), F.sum("dwell_mins").alias("dwell"))


@R.query("k8b_stays_per_day", f"WITH {stays_sql(5)}{_PER_DAY}, c AS (SELECT n_stays, count(*) AS n FROM per_day GROUP BY n_stays) SELECT n_stays, n, round(100.0::DOUBLE * n / sum(n) OVER (), 3) AS pct, round(100.0::DOUBLE * sum(n) OVER (ORDER BY n_stays) / sum(n) OVER (), 3) AS cum_pct FROM c")
def k8b(spark, d):
    return rounded(rel.running_shares(_per_day(spark, d).groupBy("n_stays").agg(F.count("*").alias("n")), ["n_stays"]), pct=3, cum_pct=3)


@R.query("k8b_subject_days", f"WITH {stays_sql(5)}{_PER_DAY} SELECT subid, count(*) AS n_days, round(avg(n_stays), 4) AS mean_stays, round(median(n_stays), 2) AS median_stays, count(*) FILTER (WHERE n_stays >= 3) AS days_3, round(100.0::DOUBLE * count(*) FILTER (WHERE n_stays >= 5) / count(*), 3) AS pct_days_5 FROM per_day GROUP BY subid")
def k8b_subjects(spark, d):
    t = _per_day(spark, d).groupBy("subid").agg(F.count("*").alias("n_days"), F.avg("n_stays").alias("mean_stays"), F.median("n_stays").alias("median_stays"), F.count_if(F.col("n_stays") >= 3).alias("days_3"), (100.0 * F.count_if(F.col("n_stays") >= 5) / F.count("*")).alias("pct_days_5"))
    return rounded(t, mean_stays=4, median_stays=2, pct_days_5=3)


_ROLLING = f"""WITH RECURSIVE {clustered_sql()}, anchors AS (SELECT DISTINCT subid, CAST(start_time AS DATE) AS date FROM clustered),
pool AS (SELECT a.subid, a.date, c.cluster_id, sum(c.dwell_mins) AS dwell, count(*) AS n FROM anchors a JOIN clustered c ON a.subid = c.subid AND CAST(c.start_time AS DATE) BETWEEN a.date - 6 AND a.date WHERE c.cluster_id > 0 GROUP BY ALL),
rolling AS (SELECT subid, date, CAST(sum(n) AS BIGINT) AS n_stays, count(*) AS n_clusters, sum(dwell) AS total, ln(sum(dwell)) - sum(dwell * ln(dwell)) / sum(dwell) AS h FROM pool GROUP BY subid, date HAVING sum(n) >= 5 AND count(*) >= 2)"""


@R.query("k9_rolling_entropy", f"{_ROLLING} SELECT subid, CAST(date AS VARCHAR) AS date, n_stays, n_clusters, round(total, 4) AS total_dwell_mins, round(h, 6) AS location_entropy, round(h / ln(n_clusters), 6) AS normalized_entropy FROM rolling")
def k9(spark, d):
    t = M.rolling_entropy(clustered(spark, d)).withColumn("date", F.col("date").cast("string"))
    return rounded(t, total_dwell_mins=4, location_entropy=6, normalized_entropy=6)


@R.query("k9b_rolling_summary", f"{_ROLLING} SELECT 'rolling' AS grain, count(*) AS n, round(avg(h), 5) AS mean_entropy, round(corr(n_clusters, h), 5) AS r_clusters, round(corr(total, h), 5) AS r_dwell FROM rolling")
def k9b(spark, d):
    places = clustered(spark, d)
    daily, rolling = (t.withColumn("grain", F.lit(g)) for t, g in ((M.daily_entropy(places), "daily"), (M.rolling_entropy(places), "rolling")))
    both = daily.unionByName(rolling).groupBy("grain").agg(F.count("*").alias("n"), F.avg("location_entropy").alias("mean_entropy"), F.corr("n_clusters", "location_entropy").alias("r_clusters"), F.corr("total_dwell_mins", "location_entropy").alias("r_dwell"))
    return rounded(both.filter("grain = 'rolling'"), mean_entropy=5, r_clusters=5, r_dwell=5)


@R.query("k10_intake_flag", "SELECT subid, utc, lat, lon, CAST(utc = min(utc) OVER (PARTITION BY subid) AS INTEGER) AS intake FROM locations")
def k10(spark, d):
    return M.intake_flag(table(spark, d, "locations")).select("subid", "utc", "lat", "lon", "intake")


@R.query("k10_second_report", f"WITH {_VISITS}, u AS (SELECT DISTINCT subid, utc FROM locations), r AS (SELECT subid, utc, row_number() OVER (PARTITION BY subid ORDER BY utc) AS i FROM u), fs AS (SELECT a.subid, a.utc AS t1, b.utc AS t2 FROM r a JOIN r b ON a.subid = b.subid AND a.i = 1 AND b.i = 2), ff AS (SELECT subid, min(visit_date) AS first_followup FROM visits WHERE NOT contains(visit_type, 'intake') GROUP BY subid) SELECT fs.subid, round((t2 - t1) / 86400.0::DOUBLE, 5) AS gap_days, CAST(make_timestamp(t2 * 1000000) AS DATE) < first_followup AS before_followup FROM fs JOIN ff USING (subid)")
def k10_second(spark, d):
    two = rel.first_per_group(table(spark, d, "locations").select("subid", "utc").distinct(), ["subid"], ["utc"], 2).groupBy("subid").agg(F.min("utc").alias("t1"), F.max("utc").alias("t2"), F.count("*").alias("n")).filter("n = 2")
    follow = visits(spark, d).filter(~F.col("visit_type").contains("intake")).groupBy("subid").agg(F.min("visit_date").alias("first_followup"))
    return two.join(follow, "subid").select("subid", F.round((F.col("t2") - F.col("t1")) / 86400, 5).alias("gap_days"), (F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("t2") / 86400).cast("int")) < F.col("first_followup")).alias("before_followup"))


@R.query("k11_temporal_filter", "SELECT l.subid, l.utc, l.lat, l.lon FROM (SELECT *, utc = min(utc) OVER (PARTITION BY subid) AS intake FROM locations) l JOIN study_dates_gps s USING (subid) WHERE l.intake OR make_timestamp(l.utc * 1000000) <= CAST(s.study_start + 2 AS TIMESTAMP) + INTERVAL 86399 SECOND")
def k11(spark, d):
    ends = table(spark, d, "study_dates_gps").select("subid", F.date_add("study_start", 2).alias("window_end"))
    t = M.intake_flag(table(spark, d, "locations")).join(ends, "subid")
    return t.filter(M.known_by(t, F.col("window_end"))).select("subid", "utc", "lat", "lon")


@R.query("k12_study_subjects", "SELECT point_id, subid FROM raw_gps SEMI JOIN study_dates_gps USING (subid)")
def k12(spark, d):
    return raw(spark, d).join(table(spark, d, "study_dates_gps").select("subid"), "subid", "left_semi").select("point_id", "subid")
