"""Trajectory operators: step metrics, quality rules, movement class, stays, windows and entropy features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import MILE_M, haversine_m, np_haversine_m
from ..session import lookup_join
from .ordered import SLICE_ROWS, Arrays, numbered, ordered_scan, with_previous
from .sessions import from_micros, micros


def valid_fixes(raw: DataFrame) -> DataFrame:
    """Rows with subid, time and coordinates in range; nulls fail."""
    return raw.filter(F.col("subid").isNotNull() & F.col("time").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def localise(df: DataFrame, time: str = "time", zone: str = "America/Chicago", to: str = "time_local") -> DataFrame:
    """Wall clock in ``zone`` of a zoneless UTC time."""
    return df.withColumn(to, F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(time)))


def step_metrics(fixes: DataFrame, id_col: str = "point_id", n_rows: int | None = None) -> DataFrame:
    """Adds dist_m, dist_miles, duration_min and speed_mph of the step from the subject's previous fix.

    Order is (time, id). The first fix of a subject has distance and duration 0; speed is 0 where no time passes. A null
    position gives a null distance and speed. Rows need subid and time; others are left out.
    """
    n_rows = fixes.count() if n_rows is None else n_rows
    rows = fixes.filter(f"subid IS NOT NULL AND time IS NOT NULL AND {id_col} IS NOT NULL").withColumn("us", micros("time"))
    lag = with_previous(rows.drop("time"), "subid", ["us", id_col], ["lat", "lon", "us"], n_rows=n_rows)
    first = F.col("prev_us").isNull()
    d = F.when(first, 0.0).otherwise(haversine_m("prev_lon", "prev_lat", "lon", "lat"))
    minutes = F.when(first, 0.0).otherwise((F.col("us") - F.col("prev_us")) / 6e7)
    out = lag.withColumns({"time": from_micros("us"), "dist_m": d, "duration_min": minutes}).withColumn("dist_miles", F.col("dist_m") / MILE_M)
    return out.withColumn("speed_mph", F.when(F.col("duration_min") > 0, F.col("dist_miles") / (F.col("duration_min") / 60)).otherwise(F.when(F.col("dist_miles").isNull(), None).otherwise(0.0))).drop("us", "prev_lat", "prev_lon", "prev_us")


def quality_filter(steps: DataFrame, rule3: str = "as_coded") -> DataFrame:
    """Drops impossible steps: moved without time passing, faster than 100 mph, or far in one step.

    ``rule3``: ``as_coded`` drops steps of over 0.31 mi that took over half a minute, ``short_gap`` those that took less.
    Steps whose test is null are dropped too. Metrics aren't recomputed.
    """
    far = {"as_coded": F.col("duration_min") > 0.5, "short_gap": F.col("duration_min") < 0.5}[rule3] & (F.col("dist_miles") > 0.31)
    return steps.filter(~((F.col("dist_miles") > 0.01) & (F.col("duration_min") == 0))).filter(~(F.col("speed_mph") > 100)).filter(~far)


def movement_class(steps: DataFrame, most_mph: float = 4.0) -> DataFrame:
    """Adds movement_state, is_stationary and rounded outputs; a null speed gives null states."""
    slow = F.col("speed_mph") <= most_mph
    return steps.withColumns({"is_stationary": slow, "movement_state": F.when(slow.isNull(), None).when(slow, "stationary").otherwise("transition"), "dwell_time_seconds": F.round(F.col("duration_min") * 60).cast("int"), "dist_miles": F.round("dist_miles", 4), "speed_mph": F.round("speed_mph", 2)})


_STAY = T.StructType([T.StructField(c, T.LongType()) for c in ("subid", "us", "first_id", "start_us", "end_us", "n_points")] + [T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])


def raw_stays(fixes: DataFrame, id_col: str, dist_m: float = 50.0, gap_min: float = 60.0, n_rows: int | None = None, time: str = "time", wall: str = "time_local", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Runs of fixes each within ``dist_m`` and ``gap_min`` of its predecessor (both inclusive), with median position.

    Order is (``time``, id); gaps, start and end are read from ``wall``, the subject's own clock.
    """

    def breaks(a: Arrays) -> np.ndarray:
        b = np.ones(len(a["us"]), bool)
        b[1:] = (a["subid"][1:] != a["subid"][:-1]) | (a["wall"][1:] - a["wall"][:-1] > gap_min * 6e7) | (np_haversine_m(a["lon"][:-1], a["lat"][:-1], a["lon"][1:], a["lat"][1:]) > dist_m)
        return b

    def kernel(a: Arrays, own: np.ndarray) -> dict:
        if not len(own):
            return {f.name: np.zeros(0) for f in _STAY}
        s = np.flatnonzero(breaks(a))
        e = np.r_[s[1:], len(own)]
        run, n = np.repeat(np.arange(len(s)), e - s), e - s

        def median(x):
            v = x[np.lexsort((x, run))]
            return (v[s + (n - 1) // 2] + v[s + n // 2]) / 2

        k = own[s]
        out = {"subid": a["subid"][s], "us": a["us"][s], "first_id": a["point"][s], "start_us": np.minimum.reduceat(a["wall"], s), "end_us": np.maximum.reduceat(a["wall"], s), "n_points": n, "lat": median(a["lat"]), "lon": median(a["lon"])}
        return {c: v[k] for c, v in out.items()}

    n_rows = fixes.count() if n_rows is None else n_rows
    rows = fixes.filter(f"subid IS NOT NULL AND {time} IS NOT NULL AND {wall} IS NOT NULL AND {id_col} IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").select(F.col("subid").cast("long").alias("subid"), micros(time).alias("us"), micros(wall).alias("wall"), F.col(id_col).cast("long").alias("point"), "lat", "lon")
    return ordered_scan(rows, ["subid", "us", "point"], _STAY, kernel, n_rows=n_rows, breaks=breaks, slice_rows=slice_rows)


def detect_stays(fixes: DataFrame, id_col: str = "processed_id", dist_m: float = 50.0, time_min: float = 10.0, gap_min: float = 60.0, max_hours: float = 12.0, n_rows: int | None = None, time: str = "time", wall: str = "time_local", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(stay_id, subid, start_time, end_time, dwell_mins, n_points, lat, lon) of stays of ``time_min`` to ``max_hours``.

    A stay may drift: each fix is held against its predecessor. stay_id numbers all stays by (subid, start). Times are
    the subject's own clock. Rows with a null key, time or position are no fixes; repeated rows count each; empty input
    gives no rows.
    """
    n_rows = fixes.count() if n_rows is None else n_rows
    raw = raw_stays(fixes, id_col, dist_m, gap_min, n_rows, time, wall, slice_rows)
    return kept_stays(raw, time_min, max_hours, n_rows).withColumn("subid", F.col("subid").cast(fixes.schema["subid"].dataType))


def kept_stays(raw: DataFrame, time_min: float, max_hours: float, n_rows: int) -> DataFrame:
    """Raw stays of the given length, numbered by (subid, start)."""
    kept = raw.withColumn("dwell_mins", (F.col("end_us") - F.col("start_us")) / 6e7).filter(F.col("dwell_mins").between(time_min, max_hours * 60))
    ids = numbered(kept, ["subid", "us", "first_id"], n_rows=max(1, n_rows // 10), name="stay_id")
    return ids.select(F.col("stay_id").cast("int").alias("stay_id"), "subid", from_micros("start_us").alias("start_time"), from_micros("end_us").alias("end_time"), "dwell_mins", "n_points", "lat", "lon")


def filter_impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, n, pct) of a filter: rows before, after, and removed."""
    a, b = before.count(), after.count()
    pct = lambda x: round(100.0 * x / a, 2) if a else None
    return before.sparkSession.createDataFrame([("before", a, pct(a)), ("after", b, pct(b)), ("removed", a - b, pct(a - b))], "metric string, n long, pct double")


def process(raw: DataFrame, id_col: str = "point_id", rule3: str = "as_coded", n_rows: int | None = None) -> DataFrame:
    """Raw points to processed fixes: valid rows, step metrics, quality rules, local time and movement class."""
    return movement_class(localise(quality_filter(step_metrics(valid_fixes(raw), id_col, n_rows), rule3)))


def sampling_by_movement(fixes: DataFrame, id_col: str = "point_id", app: str = "app_source", still_m: float = 50.0, most_gap_s: float = 3600.0) -> tuple[DataFrame, DataFrame]:
    """(gaps, ratios) for the question whether an app records less often when its subject rests.

    gaps: per (app, movement) the number, quantiles and mean of gaps under ``most_gap_s``, and the number of longer ones.
    ratios: per app the median gap at rest over that in motion, and whether it is above 1.5. First fixes and gaps of zero
    are left out. Quantiles are read at their ranks in an order of all gaps that is cut into slices, so no task holds
    the gaps of an app, however many differ.
    """
    n_rows = fixes.count()
    steps = step_metrics(fixes, id_col, n_rows).withColumn("gap_s", F.col("duration_min") * 60).filter("gap_s > 0")
    key = F.struct(F.col(app).alias("app"), F.coalesce(F.col("dist_m") <= still_m, F.lit(False)).alias("rest")).alias("key")
    ranked = numbered(steps.groupBy(key, "gap_s").agg(F.count("*").alias("n")), ["key", "gap_s"], n_rows=n_rows, name="at", start=0, weight="n")
    is_short = F.col("gap_s") < most_gap_s
    short, n_short = F.when(is_short, F.col("gap_s")), F.when(is_short, F.col("n")).otherwise(0)
    groups = ranked.groupBy("key").agg(F.min("at").alias("first"), F.sum(n_short).alias("n_points"), F.sum("n").alias("n_all"), F.min(short).alias("min_gap"), F.max(short).alias("max_gap"), F.try_divide(F.sum(short * F.col("n")), F.sum(n_short)).alias("mean_gap"))
    # short gaps come before longer ones, so their ranks among themselves are those among all
    quantiles = {c: (F.col("n_points"), p) for c, p in (("q25", 0.25), ("median_gap", 0.5), ("q75", 0.75))} | {c: (F.col("n_all"), p) for c, p in (("q95_all", 0.95), ("q99_all", 0.99))}
    rank = F.col("at") - F.col("first")
    at_rank = lambda r: F.max(F.when((rank <= r) & (r < rank + F.col("n")), F.col("gap_s")))
    place = {c: (k - 1) * F.lit(p) for c, (k, p) in quantiles.items()}
    ends = [x for c, r in place.items() for x in (at_rank(F.floor(r)).alias(f"{c}_low"), at_rank(F.ceil(r)).alias(f"{c}_high"))]
    found = lookup_join(ranked, groups, ["key"], spread="gap_s", width=F.lit(128) + F.coalesce(F.octet_length("key.app"), F.lit(0))).groupBy(*groups.columns).agg(*ends)

    def between(c: str):
        low, high, r = F.col(f"{c}_low"), F.col(f"{c}_high"), place[c]
        return F.when(quantiles[c][0] > 0, F.when(low == high, low).otherwise((F.ceil(r) - r) * low + (r - F.floor(r)) * high)).alias(c)

    movement = F.when(F.col("key.rest"), "Stationary").otherwise("Moving").alias("movement")
    gaps = found.select(F.col("key.app").alias("app"), movement, "n_points", "min_gap", between("q25"), between("median_gap"), between("q75"), "max_gap", "mean_gap", (F.col("n_all") - F.col("n_points")).alias("n_excluded"), between("q95_all"), between("q99_all"))
    wide = gaps.groupBy("app").agg(*(F.max(F.when(F.col("movement") == m, F.col("median_gap"))).alias(m.lower()) for m in ("Stationary", "Moving")))
    ratio = F.try_divide("stationary", "moving")
    return gaps, wide.select("app", "stationary", "moving", ratio.alias("ratio"), F.when(ratio.isNull(), None).when(ratio > 1.5, "likely adaptive sampling").otherwise("likely fixed-interval sampling").alias("sampling"))


def visit_windows(stays: DataFrame, visits: DataFrame, most: int = 3) -> DataFrame:
    """Stays in every follow-up window of their subject: adds fu_number and window_end.

    ``visits``: (subid, visit_type, visit_date); intakes are no follow-ups. Follow-ups are numbered by date up to
    ``most``; a window holds all stays up to its date. Windows hold each other, so a stay comes out up to ``most`` times.
    """
    follow = visits.filter(~F.col("visit_type").contains("intake") & F.col("visit_date").isNotNull()).select("subid", "visit_date").distinct()
    ends = rank_in(follow, ["subid"], ["visit_date"], "fu_number").filter(F.col("fu_number") <= most).select("subid", "fu_number", F.col("visit_date").alias("window_end"))
    return lookup_join(stays, ends, ["subid"], spread="stay_id").filter(F.to_date("start_time") <= F.col("window_end"))


def intake_flag(locations: DataFrame) -> DataFrame:
    """Adds intake: 1 for a subject's reports of its earliest time, else 0. A null time is none."""
    first = locations.groupBy("subid").agg(F.min("utc").alias("__first"))
    return lookup_join(locations, first, ["subid"], spread="utc", how="left").withColumn("intake", F.coalesce((F.col("utc") == F.col("__first")).cast("int"), F.lit(0))).drop("__first")


def known_by(locations: DataFrame, window_end: Column) -> Column:
    """Whether a report counts for a window: made at intake, or up to the last second of the window's last day in UTC."""
    return (F.col("intake") == 1) | (F.timestamp_seconds("utc") <= F.to_timestamp(F.concat(window_end.cast("string"), F.lit(" 23:59:59"))))


def daily_entropy(stays: DataFrame, least_stays: int = 3, least_clusters: int = 2, grain: str = "stay") -> DataFrame:
    """Location entropy per (subid, date) of stays with a cluster_id (0 is noise, and doesn't count as a place).

    ``grain="stay"``: proportions per stay in clusters; ``"cluster"``: per cluster. Normalised by the log of the number of
    clusters. Days with fewer stays or clusters are left out.
    """
    days = stays.withColumn("date", F.to_date("start_time"))
    return _entropy(days, ["subid", "date"], least_stays, least_clusters, grain, noise_counts=True)


def _entropy(rows: DataFrame, keys: list[str], least_stays: int, least_clusters: int, grain: str, noise_counts: bool) -> DataFrame:
    placed = F.col("cluster_id") > 0
    if grain == "cluster":
        rows = rows.groupBy(*keys, "cluster_id").agg(F.sum("dwell_mins").alias("dwell_mins"), F.count("*").alias("k"))
    else:
        rows = rows.withColumn("k", F.lit(1))
    d = F.when(placed, F.col("dwell_mins"))
    counted = F.lit(True) if noise_counts else placed
    # H = ln T - sum(d ln d) / T
    agg = rows.groupBy(*keys).agg(F.sum(F.when(counted, F.col("k"))).alias("n_stays"), F.countDistinct(F.when(placed, F.col("cluster_id"))).alias("n_clusters"), F.sum(F.when(counted, F.col("dwell_mins"))).alias("total_dwell_mins"), F.sum(d).alias("t"), F.sum(F.when(d > 0, d * F.log(d))).alias("s"))
    h = F.log("t") - F.col("s") / F.col("t")
    return agg.filter((F.col("n_stays") >= least_stays) & (F.col("n_clusters") >= least_clusters)).select(*keys, F.col("n_stays").cast("long").alias("n_stays"), "n_clusters", "total_dwell_mins", h.alias("location_entropy"), (h / F.log(F.col("n_clusters").cast("double"))).alias("normalized_entropy"))


def rolling_entropy(stays: DataFrame, days: int = 7, least_stays: int = 5, least_clusters: int = 2) -> DataFrame:
    """Entropy per cluster over the ``days`` days up to each date with a stay (no gap filling); noise is left out.

    The band join is an equi-join: stays are pooled per (subid, date, cluster) first, and each pool is written to the
    ``days`` dates that look back on it.
    """
    dated = stays.withColumn("stay_date", F.to_date("start_time"))
    pools = dated.filter("cluster_id > 0").groupBy("subid", "stay_date", "cluster_id").agg(F.sum("dwell_mins").alias("dwell_mins"), F.count("*").alias("k"))
    seen = pools.withColumn("date", F.explode(F.sequence(F.col("stay_date"), F.date_add("stay_date", days - 1))))
    anchors = dated.select("subid", F.col("stay_date").alias("date")).distinct()
    windows = seen.join(anchors, ["subid", "date"]).groupBy("subid", "date", "cluster_id").agg(F.sum("dwell_mins").alias("dwell_mins"), F.sum("k").alias("k"))
    # pools are already one row per cluster
    d = F.col("dwell_mins")
    agg = windows.groupBy("subid", "date").agg(F.sum("k").alias("n_stays"), F.count("*").alias("n_clusters"), F.sum(d).alias("total_dwell_mins"), F.sum(F.when(d > 0, d * F.log(d))).alias("s"))
    h = F.log("total_dwell_mins") - F.col("s") / F.col("total_dwell_mins")
    return agg.filter((F.col("n_stays") >= least_stays) & (F.col("n_clusters") >= least_clusters)).select("subid", "date", "n_stays", "n_clusters", "total_dwell_mins", h.alias("location_entropy"), (h / F.log(F.col("n_clusters").cast("double"))).alias("normalized_entropy"))


def cumulative_windows(stays: DataFrame, step_days: int = 7) -> DataFrame:
    """Each stay in every expanding window that holds it: adds study_day and window_days (7, 14, ... up to the span).

    study_day is the fractional number of days since the subject's first stay plus 1. A last, partial window is dropped.
    """
    span = stays.groupBy("subid").agg(F.min("start_time").alias("first_start"), F.max("start_time").alias("last_start"))
    day = lambda c: F.expr(f"timestampdiff(MICROSECOND, first_start, {c}) / 86400000000.0D + 1")
    windows = span.withColumn("max_day", day("last_start")).filter(F.col("max_day") >= step_days).withColumn("window_days", F.explode(F.sequence(F.lit(step_days), F.floor("max_day").cast("int"), F.lit(step_days))))
    return stays.join(windows.select("subid", "first_start", "window_days"), "subid").withColumn("study_day", day("start_time")).filter(F.col("study_day") <= F.col("window_days")).drop("first_start")


def rank_in(df: DataFrame, by: list[str], order: list, name: str = "rank_no") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
