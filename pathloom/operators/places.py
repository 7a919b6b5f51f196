"""Clusters of stays and reported places per subject, and how well one set of places finds another.

Kernels run per subject on positions pooled with their counts, so a place visited a million times at one position is
one row there. Comparisons between two sets of places are radius joins by cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import np_haversine_m
from ..session import lookup_join, materialize
from .graph import dbscan, distance_matrix, match_pairs, pams, silhouette, silhouette_of
from .proximity import radius_join


def _per_subject(df: DataFrame, keys: list[str], f, extra: str) -> DataFrame:
    names = df.columns
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(extra).fields])
    return df.groupBy(*keys).applyInPandas(lambda p: f(p.reset_index(drop=True))[[*names, *(x.name for x in schema.fields[len(names) :])]], schema)


def cluster_stays(stays: DataFrame, eps_m: float = 50.0, min_pts: int = 2, keys: list[str] = ["subid"], singleton: str = "cluster", row: str = "stay_id", name: str = "cluster_id") -> DataFrame:  # noqa: B006
    """Stays with the cluster of their subject they lie in, by density; 0 is noise.

    ``eps_m`` is inclusive, ``min_pts`` counts the stay itself. Clusters are numbered from 1 by their first core stay in
    the order of ``row``; a border stay goes to the lowest-numbered cluster in reach. A subject's only stay is cluster 1
    (``singleton="cluster"``) or judged like any other (``"noise"``). Stays with a null position are left out.
    """
    one = 1 if singleton == "cluster" else 0

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(row, kind="stable")
        p[name] = (np.full(len(p), one if len(p) < 2 and min_pts > 1 else 1) if len(p) < 2 else dbscan(p["lon"].to_numpy(), p["lat"].to_numpy(), eps_m, min_pts)).astype(np.int32)
        return p

    return _per_subject(stays.filter("lat IS NOT NULL AND lon IS NOT NULL"), keys, run, f"`{name}` int")


def _labels(lon: np.ndarray, lat: np.ndarray, k_from: int, k_to: int, fallback: bool) -> tuple[np.ndarray, int]:
    n = len(lat)
    spots, at = np.unique(np.stack([lon, lat], 1), axis=0, return_inverse=True)
    at, k_to = at.ravel(), min(k_to, n - 1, len(spots))
    d, w = distance_matrix(spots[:, 0], spots[:, 1]), np.bincount(at.ravel()).astype(float)
    best, label = -np.inf, np.zeros(len(spots), np.int64)
    for got in pams(d, k_from, k_to, w):
        s = silhouette(d, got, w)
        if s > best + 1e-12:
            best, label = s, got
    if fallback and best < 0.25 and d.max() <= 200:
        label = np.zeros(len(spots), np.int64)
    # numbered by first row
    names, first = np.unique(label[at], return_index=True)
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(first)] = np.arange(1, len(names) + 1)
    return rank[np.searchsorted(names, label[at])], len(names)


def medoid_clusters(stays: DataFrame, k_from: int = 3, k_to: int = 20, fallback: bool = False, keys: list[str] = ["subid"], row: str = "stay_id") -> DataFrame:  # noqa: B006
    """Stays with cluster_id_kmeans and optimal_k: partitions around medoids, with the number of clusters of the largest
    mean silhouette (the smallest of equal ones).

    Under three stays are one cluster, three are two. With ``fallback`` (numbers from 2 on) under three stays are one
    cluster, and a subject whose best silhouette is under 0.25 and whose stays all lie within 200 m is one as well.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(row, kind="stable")
        lon, lat, n = p["lon"].to_numpy(), p["lat"].to_numpy(), len(p)
        if n < 3 or len(np.unique(np.stack([lon, lat], 1), axis=0)) < 2:
            label, k = np.ones(n, np.int64), 1
        elif n == 3 and not fallback:
            label, k = _labels(lon, lat, 2, 2, False)
        else:
            label, k = _labels(lon, lat, k_from, k_to, fallback)
        p["cluster_id_kmeans"], p["optimal_k"] = label.astype(np.int32), np.int32(k)
        return p

    return _per_subject(stays.filter("lat IS NOT NULL AND lon IS NOT NULL"), keys, run, "cluster_id_kmeans int, optimal_k int")


def centroids(clustered: DataFrame, keys: list[str] = ["subid"], label: str = "cluster_id") -> DataFrame:  # noqa: B006
    """(keys..., cluster, lat, lon, total_dwell_mins, mean_dwell_mins, n_stays, n_days): medians and sums; noise is left out."""
    t = clustered.filter(F.col(label) > 0).groupBy(*keys, F.col(label))
    return t.agg(F.median("lat").alias("lat"), F.median("lon").alias("lon"), F.sum("dwell_mins").alias("total_dwell_mins"), F.avg("dwell_mins").alias("mean_dwell_mins"), F.count("*").alias("n_stays"), F.countDistinct(F.to_date("start_time")).alias("n_days"))


def routine(places: DataFrame, least_days: int = 3, least_mins: float = 60.0) -> DataFrame:
    """Places of at least so many days and minutes."""
    return places.filter((F.col("n_days") >= least_days) & (F.col("total_dwell_mins") >= least_mins))


def dedupe_locations(locations: DataFrame, radius_m: float = 50.0) -> DataFrame:
    """(subid, location_id, lat, lon, n_reports, intake, types): reports of one place, chained within ``radius_m``, as one.

    Median position, number of reports, whether any was made at intake, and its distinct types. ``location_id`` numbers a
    subject's places by their first report in the order of (utc, lat, lon). Equal positions are pooled before they are
    compared. Reports with a null position or subject are left out.
    """
    t = locations.filter("subid IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    spots = t.groupBy("subid", "lat", "lon").agg(F.min("utc").alias("first"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["first", "lat", "lon"], kind="stable").reset_index(drop=True)
        # density clusters of one are chains of positions in reach, numbered by their first
        p["location_id"] = dbscan(p["lon"].to_numpy(), p["lat"].to_numpy(), radius_m, 1).astype(np.int32)
        return p

    ids = _per_subject(spots, ["subid"], run, "location_id int").drop("first")
    placed = t.join(ids, ["subid", "lat", "lon"])
    kinds = F.array_join(F.array_sort(F.collect_set(F.lower("type"))), ", ")
    return placed.groupBy("subid", "location_id").agg(F.median("lat").alias("lat"), F.median("lon").alias("lon"), F.count("*").alias("n_reports"), F.max("intake").alias("intake"), kinds.alias("types"))


def _side(places: DataFrame, key: list[str]) -> DataFrame:
    return places.select("subid", *key, "lat", "lon")


def seen_locations(locations: DataFrame, stays: DataFrame, key: list[str], radius_m: float = 100.0) -> DataFrame:
    """Locations with at least one stay (or ping) of their subject within ``radius_m``. Empty sides give no rows.

    Stays are pooled to distinct positions; each location comes out once.
    """
    spots = stays.select("subid", "lat", "lon").distinct()
    near = radius_join(spots, _side(locations, key).withColumnsRenamed({"lat": "olat", "lon": "olon"}), radius_m, by=["subid"]).select("subid", *key).distinct()
    return locations.join(near, ["subid", *key], "left_semi")


def dwell_at(locations: DataFrame, stays: DataFrame, key: list[str], radius_m: float = 100.0, major_mins: float = 120.0) -> DataFrame:
    """Locations with n_stays and dwell_mins of their subject's stays within ``radius_m`` (0 if none), and whether major."""
    near = radius_join(stays.select("subid", "lat", "lon", "dwell_mins"), _side(locations, key).withColumnsRenamed({"lat": "olat", "lon": "olon"}), radius_m, by=["subid"])
    t = near.groupBy("subid", *key).agg(F.count("*").alias("n_stays"), F.sum("dwell_mins").alias("dwell_mins"))
    out = locations.join(t, ["subid", *key], "left").fillna({"n_stays": 0, "dwell_mins": 0.0})
    return out.withColumn("major", F.col("dwell_mins") >= major_mins)


def near_edges(places: DataFrame, truth: DataFrame, radius_m: float, by: list[str] = ["subid"], left: str = "cluster_id", right: str = "location_id") -> DataFrame:  # noqa: B006
    """(by..., left, right, dist_m) of places and true locations of a group within ``radius_m``.

    Locations that lack some columns of ``by`` belong to all groups that are equal in the others.
    """
    own = [c for c in by if c in truth.columns]
    a = places.select(*by, left, "lat", "lon")
    b = truth.select(*own, right, F.col("lat").alias("olat"), F.col("lon").alias("olon"))
    return radius_join(a, b, radius_m, by=own).select(*by, left, right, "dist_m")


def capture(places: DataFrame, truth: DataFrame, radius_m: float = 100.0, by: list[str] = ["subid"], left: str = "cluster_id", right: str = "location_id", one_to_one: bool = False) -> DataFrame:  # noqa: B006
    """(by..., n_places, n_truth, matched_places, matched_truth, precision, recall, f1) of groups on both sides.

    A place or location counts as matched with one of the other side within ``radius_m``; with ``one_to_one`` as many
    pairs are matched as can be, each place and location once. Ratios of empty sides are 0. Groups on one side only are
    left out. ``truth`` may lack columns of ``by``, as in :func:`near_edges`.
    """
    own = [c for c in by if c in truth.columns]
    n = places.groupBy(*by).agg(F.count("*").alias("n_places")).join(truth.groupBy(*own).agg(F.count("*").alias("n_truth")), own)
    edges = near_edges(places, truth, radius_m, by, left, right)
    hits = matched(edges, by, left, right).groupBy(*by).agg(F.count("*").alias("matched_places"), F.count("*").alias("matched_truth")) if one_to_one else edges.groupBy(*by).agg(F.countDistinct(left).alias("matched_places"), F.countDistinct(right).alias("matched_truth"))
    t = n.join(hits, by, "left").fillna(0, ["matched_places", "matched_truth"])
    p, r = F.col("matched_places") / F.col("n_places"), F.col("matched_truth") / F.col("n_truth")
    t = t.withColumns({"precision": p, "recall": r})
    return t.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def matched(edges: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """(by..., left, right) of a largest one-to-one matching; near pairs are tried first. Only the count is unique.

    Runs per group of edges, which are few: pairs of places within the radius.
    """
    schema = T.StructType([f for f in edges.schema if f.name in (*by, left, right)])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["dist_m", left, right])
        pairs = match_pairs(list(zip(p[left].tolist(), p[right].tolist(), strict=True)))
        out = pd.DataFrame(list(pairs.items()), columns=[left, right])
        for c in by:
            out[c] = p[c].iloc[0]
        return out[[f.name for f in schema]]

    return edges.groupBy(*by).applyInPandas(run, schema)


def nearest_stay(locations: DataFrame, stays: DataFrame, key: list[str], bands: tuple[float, ...] = (50.0, 100.0, 500.0)) -> DataFrame:
    """Locations with n_50, n_100, dwell_100, nearest_m (null beyond the widest band) and the band of the nearest stay."""
    near = radius_join(stays.select("subid", "lat", "lon", "dwell_mins"), _side(locations, key).withColumnsRenamed({"lat": "olat", "lon": "olon"}), max(bands), by=["subid"])
    d = F.col("dist_m")
    t = near.groupBy("subid", *key).agg(F.min(d).alias("nearest_m"), F.count_if(d <= 50).alias("n_50"), F.count_if(d <= 100).alias("n_100"), F.sum(F.when(d <= 100, F.col("dwell_mins")).otherwise(0.0)).alias("dwell_100"))
    out = locations.join(t, ["subid", *key], "left").fillna({"n_50": 0, "n_100": 0, "dwell_100": 0.0})
    case: Column = F
    for b in bands:
        case = case.when(F.col("nearest_m") <= b, f"within {b:g} m")
    return out.withColumn("evidence", case.otherwise("none"))


def spread_within(clustered: DataFrame, label: str = "cluster_id") -> DataFrame:
    """(subid, cluster, n, mean_pair_m): mean distance of every two stays of a cluster, 0 with fewer than two.

    Distances are summed row by row in a kernel over the cluster's pooled positions; no pairs are formed as rows.
    """
    spots = clustered.filter(F.col(label) > 0).groupBy("subid", label, "lat", "lon").agg(F.count("*").alias("w"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        lon, lat, w = p["lon"].to_numpy(), p["lat"].to_numpy(), p["w"].to_numpy(float)
        total = sum(w[i] * (w * np_haversine_m(lon, lat, lon[i], lat[i])).sum() for i in range(len(w)))
        n = w.sum()
        return pd.DataFrame({"subid": p["subid"].iloc[:1], label: p[label].iloc[:1], "n": np.int64(n), "mean_pair_m": total / (n * (n - 1)) if n > 1 else 0.0})

    return spots.groupBy("subid", label).applyInPandas(run, T.StructType([spots.schema["subid"], spots.schema[label], T.StructField("n", T.LongType()), T.StructField("mean_pair_m", T.DoubleType())]))


def silhouettes(clustered: DataFrame, label: str = "cluster_id") -> DataFrame:
    """(subid, n_clusters, silhouette): mean silhouette width of a subject's clustered stays; null with fewer than two clusters."""
    spots = clustered.filter(F.col(label) > 0).groupBy("subid", label, "lat", "lon").agg(F.count("*").alias("w"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        s = silhouette_of(p["lon"].to_numpy(), p["lat"].to_numpy(), p[label].to_numpy(), p["w"].to_numpy(float))
        return pd.DataFrame({"subid": p["subid"].iloc[:1], "n_clusters": np.int64(p[label].nunique()), "silhouette": None if s != s else s})

    return spots.groupBy("subid").applyInPandas(run, T.StructType([spots.schema["subid"], T.StructField("n_clusters", T.LongType()), T.StructField("silhouette", T.DoubleType())]))


def outliers(clustered: DataFrame, places: DataFrame, label: str = "cluster_id", sds: float = 2.0) -> DataFrame:
    """Clustered stays with dist_m from their centroid and whether that is over the cluster's mean plus ``sds`` deviations."""
    from ..functions.geo import haversine_m

    at = places.select("subid", label, F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    t = lookup_join(clustered.filter(F.col(label) > 0), at, ["subid", label], spread="stay_id").withColumn("dist_m", haversine_m("lon", "lat", "clon", "clat"))
    stats = t.groupBy("subid", label).agg(F.avg("dist_m").alias("mean_m"), F.stddev_samp("dist_m").alias("sd_m"))
    return lookup_join(t, stats, ["subid", label], spread="stay_id").withColumn("outlier", F.coalesce(F.col("dist_m") > F.col("mean_m") + sds * F.col("sd_m"), F.lit(False)))


def home_share(places: DataFrame) -> DataFrame:
    """Each subject's place (or places, of equal dwell) of most dwell and its percentage of all clustered dwell."""
    t = places.groupBy("subid").agg(F.sum("total_dwell_mins").alias("__all"), F.max("total_dwell_mins").alias("__top"))
    return places.join(t, "subid").filter(F.col("total_dwell_mins") == F.col("__top")).withColumn("home_pct", 100.0 * F.col("total_dwell_mins") / F.col("__all")).drop("__all", "__top")


def grid_search(per_dwell: dict[float, DataFrame], truth: DataFrame, eps: list[float], min_pts: list[int], radius_m: float = 100.0) -> DataFrame:
    """(dwell_threshold, eps_meters, min_pts, subid, measures of :func:`capture`) for every combination of parameters.

    Stays are detected once a dwell threshold; all combinations are clustered in one plan, grouped by (combination, subject).
    """
    every = None
    for dwell, s in per_dwell.items():
        one = s.withColumn("dwell_threshold", F.lit(float(dwell)))
        every = one if every is None else every.unionByName(one)
    params = F.explode(F.array(*(F.struct(F.lit(float(e)).alias("eps_meters"), F.lit(m).alias("min_pts")) for e in eps for m in min_pts)))
    runs = every.withColumn("p", params).select("*", "p.*").drop("p")
    by = ["dwell_threshold", "eps_meters", "min_pts", "subid"]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("stay_id", kind="stable")
        p["cluster_id"] = (dbscan(p["lon"].to_numpy(), p["lat"].to_numpy(), p["eps_meters"].iloc[0], int(p["min_pts"].iloc[0])) if len(p) > 1 else np.ones(len(p))).astype(np.int32)
        return p

    found = centroids(_per_subject(runs, by, run, "cluster_id int"), by)
    found = materialize(found)
    combos = found.select(*by).distinct()
    return capture(found, truth.join(combos, "subid"), radius_m, by)


def concordance(places: DataFrame, truth: DataFrame, by: list[str], radius_m: float = 100.0, left: str = "cluster_id", right: str = "location_id") -> DataFrame:
    """(by..., n_a, n_b, n_concordant, n_a_only, n_b_only, concordance) by one-to-one matching; also groups of one side.

    concordance is the share of matched pairs in all distinct places of both sides.
    """
    n = places.groupBy(*by).agg(F.count("*").alias("n_a")).join(truth.groupBy(*by).agg(F.count("*").alias("n_b")), by, "full")
    hit = matched(near_edges(places, truth, radius_m, by, left, right), by, left, right).groupBy(*by).agg(F.count("*").alias("n_concordant"))
    t = n.join(hit, by, "left").fillna(0, ["n_a", "n_b", "n_concordant"])
    t = t.withColumns({"n_a_only": F.col("n_a") - F.col("n_concordant"), "n_b_only": F.col("n_b") - F.col("n_concordant")})
    return t.withColumn("concordance", F.try_divide("n_concordant", F.col("n_concordant") + F.col("n_a_only") + F.col("n_b_only")))


def rank_by_subject(df: DataFrame, order: list, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy("subid").orderBy(*order)))
