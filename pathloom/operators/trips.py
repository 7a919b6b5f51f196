"""Stops and trips from noisy, gappy location fixes, with recurring places.

1. Stationary stretches: longest runs of successive fixes of which every two lie within a radius, without a long
   silence, lasting long enough. They are found in an ordered scan; two fixes far apart or long silent part the scan.
2. Places: the stretches' median positions are pooled in small cells per subject; cells near each other form a
   proximity graph of bounded degree. Its communities, by label propagation, are the recurring places.
3. Visits: successive stretches at one place, with no silence between. Trips lead from a stretch to the next, of the same
   visit or of the next one, with the way covered between.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import EARTH_M, haversine_m, np_haversine_m
from ..session import materialize, small
from .ordered import SLICE_ROWS, Arrays, ordered_scan
from .readings import FIX_ORDER, ReadingRules, fixes_of, implausible_readings
from .sessions import from_micros

_EVENT = T.StructType([T.StructField("subid", T.LongType()), T.StructField("us", T.LongType()), T.StructField("processed_id", T.LongType()), T.StructField("code", T.LongType()), T.StructField("end_us", T.LongType()), T.StructField("end_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("way_m", T.DoubleType())])
_TRIP = T.StructType([T.StructField("subid", T.LongType()), T.StructField("start_us", T.LongType()), T.StructField("start_id", T.LongType()), T.StructField("end_us", T.LongType()), T.StructField("end_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("way_m", T.DoubleType()), T.StructField("from_us", T.LongType()), T.StructField("to_us", T.LongType())])
# what an event row stands for, in the order of rows that share a fix
SILENCE, WAY, ARRIVAL, LEAVE = 0, 1, 2, 3


def without(gps: DataFrame, cases: DataFrame, key: str = "processed_id") -> DataFrame:
    """``gps`` less the rows whose key is among ``cases``; sent to all tasks only if counted to be few."""
    cases = materialize(cases.select(key).distinct())
    return gps.join(F.broadcast(cases) if small(cases) else cases, key, "left_anti")


def plausible_positions(gps: DataFrame, rules: ReadingRules = ReadingRules(), n_rows: int | None = None) -> DataFrame:
    """Fixes whose position can be right: without those whose latitude is an implausible reading."""
    return without(gps, implausible_readings(gps, rules, n_rows).filter("measure = 'lat'"))


#: Fixes that are added to a window at once where its hull allows.
BLOCK = 256


def _extremes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions of the convex hull's corners (monotone chain); the farthest two of a set are among them."""
    order = np.lexsort((y, x))
    xs, ys = x[order].tolist(), y[order].tolist()

    def chain(seq):
        out: list[int] = []
        for i in seq:
            while len(out) > 1 and (xs[out[-1]] - xs[out[-2]]) * (ys[i] - ys[out[-2]]) - (ys[out[-1]] - ys[out[-2]]) * (xs[i] - xs[out[-2]]) <= 0:
                out.pop()
            out.append(i)
        return out

    return order[np.unique(chain(range(len(xs))) + chain(range(len(xs) - 1, -1, -1)))]


def window_starts(lat: np.ndarray, lon: np.ndarray, radius_m: float) -> np.ndarray:
    """For each of successive fixes the first fix of the longest window that ends with it, every two within the radius.

    Distances are taken in a plane about the fixes, and on the sphere where the plane leaves them open. A block of fixes
    joins its window at once if the hull of both is narrow enough, so a long quiet stop costs about its length.
    """
    n = len(lat)
    starts = np.zeros(n, np.int64)
    if n < 2:
        return starts
    mid = float(lat[n // 2])
    x = np.radians(lon - lon[0]) * EARTH_M * np.cos(np.radians(mid))
    y = np.radians(lat - mid) * EARTH_M
    # the plane's error over the radius: its width is right at one latitude
    slack = 0.05 + radius_m * float(np.abs(np.radians(lat - mid)).max()) * (abs(np.tan(np.radians(mid))) + 1)
    near2, far2 = max(0.0, radius_m - slack) ** 2, (radius_m + slack) ** 2
    if float(np.hypot(x.max() - x.min(), y.max() - y.min())) ** 2 <= near2:
        return starts

    def narrow(at: np.ndarray) -> bool:
        return float(((x[at, None] - x[at]) ** 2 + (y[at, None] - y[at]) ** 2).max()) <= near2

    lo, j = 0, 1
    hull, hull_lo, hull_to = np.array([0]), 0, 1  # of the window lo..hull_to-1
    while j < n:
        if j + BLOCK <= n or j - lo >= BLOCK:
            if hull_lo != lo:
                hull, hull_lo, hull_to = np.arange(lo, lo + 1), lo, lo + 1
            to = min(n, j + BLOCK)
            at = np.r_[hull, np.arange(hull_to, to)]
            at = at[_extremes(x[at], y[at])]
            if narrow(at):
                starts[j:to] = lo
                hull, hull_to, j = at, to, to
                continue
        for j in range(j, min(n, j + BLOCK)):
            d2 = (x[lo:j] - x[j]) ** 2 + (y[lo:j] - y[j]) ** 2
            far = d2 > near2
            if far.any():
                at = np.flatnonzero(far) + lo
                open_ = d2[at - lo] <= far2
                if open_.any():
                    keep = ~open_
                    keep[open_] = np_haversine_m(lon[at[open_]], lat[at[open_]], lon[j], lat[j]) > radius_m
                    at = at[keep]
                if len(at):
                    lo = int(at[-1]) + 1
            starts[j] = lo
        j += 1
    return starts


def longest_windows(lat: np.ndarray, lon: np.ndarray, sec: np.ndarray, radius_m: float, least_s: float) -> list[tuple[int, int]]:
    """All longest (not extendable) windows [i, j] of successive fixes, every two within the radius, lasting ``least_s``."""
    starts = window_starts(lat, lon, radius_m)
    ends = np.flatnonzero(np.r_[starts[1:] > starts[:-1], True]) if len(starts) else np.zeros(0, np.int64)
    return [(int(i), int(j)) for i, j in zip(starts[ends], ends, strict=True) if sec[j] - sec[i] >= least_s]


def stop_kernel(radius_m: float, least_s: float, silence_s: float):
    def breaks(a: Arrays) -> np.ndarray:
        b = np.ones(len(a["us"]), bool)
        b[1:] = (a["subid"][1:] != a["subid"][:-1]) | (a["us"][1:] - a["us"][:-1] > silence_s * 1e6) | ~(np_haversine_m(a["lon"][:-1], a["lat"][:-1], a["lon"][1:], a["lat"][1:]) <= radius_m)
        return b

    def starts_of(a: Arrays) -> np.ndarray:
        """First fix of the longest window that ends with each fix; windows don't go over breaks."""
        if "__starts" not in a:
            cut = np.flatnonzero(breaks(a))
            out = np.zeros(len(a["us"]), np.int64)
            for s, e in zip(cut, np.r_[cut[1:], len(out)], strict=True):
                out[s:e] = s + (window_starts(a["lat"][s:e], a["lon"][s:e], radius_m) if e - s > 1 else 0)
            a["__starts"] = out
        return a["__starts"]

    def edges(a: Arrays) -> tuple[int, int, int, int] | None:
        """What a slice can't decide: fixes and windows before the first fix whose window is known to begin in the slice,
        and those from the start of the last window on. Windows that cover such fixes are shown whole."""
        starts = starts_of(a)
        k = len(starts)
        known = int(np.searchsorted(starts, 0, side="right"))  # starts never fall
        closed = int(np.searchsorted(starts, known))
        last = int(starts[-1])
        if closed >= k or last < known:
            return None
        return known, closed + 1, last, min(int(starts[last]), last - 1)

    def kernel(a: Arrays, own: np.ndarray) -> dict:
        n, sec = len(own), a["us"] / 1e6
        rows: list[list] = [[] for _ in _EVENT]

        def put(*values):
            for c, v in zip(rows, values, strict=True):
                c.append(np.asarray(v))

        z = lambda k: np.zeros(k, np.int64)
        starts = starts_of(a)
        stop_of = np.full(n, -1)
        stops = []
        ends = np.flatnonzero(np.r_[starts[1:] > starts[:-1], True]) if n else np.zeros(0, np.int64)
        for number, j in enumerate(ends[sec[ends] - sec[starts[ends]] >= least_s].tolist()):
            i = int(starts[j])
            stop_of[i : j + 1] = number
            if own[i]:
                stops.append((i, j))
        if stops:
            i, j = np.array(stops).T
            lat = [np.median(a["lat"][x : y + 1]) for x, y in stops]
            lon = [np.median(a["lon"][x : y + 1]) for x, y in stops]
            put(a["subid"][i], a["us"][i], a["processed_id"][i], np.full(len(i), ARRIVAL), a["us"][j], a["processed_id"][j], j - i + 1, lat, lon, np.zeros(len(i)))
            put(a["subid"][j], a["us"][j], a["processed_id"][j], np.full(len(i), LEAVE), a["us"][i], a["processed_id"][i], j - i + 1, lat, lon, np.zeros(len(i)))
        if n > 1:
            same = np.r_[False, a["subid"][1:] == a["subid"][:-1]]
            quiet = np.flatnonzero(same & own & np.r_[False, a["us"][1:] - a["us"][:-1] > silence_s * 1e6])
            k = len(quiet)
            put(a["subid"][quiet], a["us"][quiet], a["processed_id"][quiet], np.full(k, SILENCE), z(k), z(k), z(k), np.zeros(k), np.zeros(k), np.zeros(k))
            # the way between stops: steps into fixes that aren't inside one, summed over each stretch between them
            inside = (stop_of >= 0) & (np.r_[-1, stop_of[:-1]] == stop_of)
            moving = np.flatnonzero(same & own & ~inside)
            if len(moving):
                length = np.nan_to_num(np_haversine_m(a["lon"][moving - 1], a["lat"][moving - 1], a["lon"][moving], a["lat"][moving]))
                new = np.ones(len(moving), bool)
                new[1:] = (moving[1:] != moving[:-1] + 1) | (stop_of[moving[1:] - 1] >= 0)
                g = np.cumsum(new) - 1
                f = moving[new]
                k = len(f)
                put(a["subid"][f], a["us"][f], a["processed_id"][f], np.full(k, WAY), z(k), z(k), np.bincount(g), np.zeros(k), np.zeros(k), np.bincount(g, weights=length))
        return {f.name: np.concatenate(c) if c else np.zeros(0) for f, c in zip(_EVENT, rows, strict=True)}

    return edges, kernel


def _trip_breaks(a: Arrays) -> np.ndarray:
    b = np.ones(len(a["us"]), bool)
    b[1:] = (a["subid"][1:] != a["subid"][:-1]) | (a["code"][1:] == LEAVE)
    return b


def _trip_kernel(a: Arrays, own: np.ndarray) -> dict:
    b, code = _trip_breaks(a), a["code"]
    s = np.flatnonzero(b)
    seg = np.cumsum(b) - 1
    e = np.r_[s[1:], len(code)] - 1
    quiet = np.bincount(seg, weights=code == SILENCE, minlength=len(s)) if len(s) else np.zeros(0)
    way = np.bincount(seg, weights=a["way_m"], minlength=len(s)) if len(s) else np.zeros(0)
    fixes = np.bincount(seg, weights=np.where(code == WAY, a["n"], 0), minlength=len(s)).astype(np.int64) if len(s) else np.zeros(0, np.int64)
    ok = (quiet == 0) & (code[s] == LEAVE) & (code[e] == ARRIVAL) & own[s] if len(s) else np.zeros(0, bool)
    s, e = s[ok], e[ok]
    return {"subid": a["subid"][s], "start_us": a["us"][s], "start_id": a["processed_id"][s], "end_us": a["us"][e], "end_id": a["processed_id"][e], "n": fixes[ok], "way_m": way[ok], "from_us": a["end_us"][s], "to_us": a["us"][e]}


def places(stops: DataFrame, near_m: float = 50.0, cell_m: float = 20.0, rounds: int = 12) -> DataFrame:
    """(subid, cx, cy, place): the community of each occupied cell of the stops' medians.

    ``stops`` needs subid, lat, lon, weight. Cells are pooled before anything is joined, so a place visited a million
    times is a few cells, and a cell has a bounded number of neighbours; no pairs of stops are formed. Cells up to
    ``near_m`` apart are linked by the product of their weights, less with distance. Communities come by label
    propagation: each cell takes the label that its neighbours pull to most, if that label's cell is heavier than its
    own label's, so labels settle; until none changes or for so many ``rounds``. A community is named by the cell whose
    label it carries.
    """
    size = float(np.degrees(cell_m / EARTH_M))
    cells = stops.select("subid", "lat", "lon", "weight", *_cell("lat", "lon", size)).groupBy("subid", "cx", "cy").agg(F.sum("weight").alias("w"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    cells = materialize(cells)
    span = int(np.ceil(near_m / cell_m))
    around = F.explode(F.sequence(F.lit(-span), F.lit(span)))
    # columns are counted by the width of the row looked into, which may lie in another latitude band than the cell
    seen = cells.select("subid", "cx", "cy", "w", "lat", "lon").withColumn("dy", around).withColumn("dx", F.explode(F.sequence(F.lit(-span - 1), F.lit(span + 1)))).withColumn("oy", F.col("cy") + F.col("dy"))
    other = cells.select("subid", F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("w").alias("ow"), F.col("lat").alias("olat"), F.col("lon").alias("olon"))
    dist = haversine_m("lon", "lat", "olon", "olat")
    linked = (dist <= near_m) & ((F.col("ox") != F.col("cx")) | (F.col("oy") != F.col("cy")))
    edges = seen.withColumn("ox", _column("lon", "oy", size) + F.col("dx")).join(other, ["subid", "ox", "oy"]).filter(linked)
    edges = materialize(edges.select("subid", "cx", "cy", "ox", "oy", (F.col("ow") / (1 + dist / cell_m)).alias("pull")))
    # a label is its cell with the cell's weight first
    labels = cells.select("subid", "cx", "cy", F.struct("w", "cx", "cy").alias("label"))
    for _ in range(rounds):
        votes = edges.join(labels.select("subid", F.col("cx").alias("ox"), F.col("cy").alias("oy"), "label"), ["subid", "ox", "oy"]).groupBy("subid", "cx", "cy", "label").agg(F.round(F.sum("pull"), 6).alias("pull"))
        higher = votes.join(labels.withColumnRenamed("label", "own"), ["subid", "cx", "cy"]).filter("label >= own")
        top = higher.groupBy("subid", "cx", "cy").agg(F.max(F.struct("pull", "label")).alias("top"))
        new = materialize(labels.join(top, ["subid", "cx", "cy"], "left").select("subid", "cx", "cy", F.coalesce("top.label", "label").alias("label"), F.coalesce(F.col("top.label") != F.col("label"), F.lit(False)).alias("moved")))
        labels = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            break
    return labels.select("subid", "cx", "cy", F.concat_ws(":", "subid", "label.cx", "label.cy").alias("place"))


def _cell(lat: str, lon: str, size: float):
    """Cell of ``size`` degrees of latitude, as wide in metres; its width is fixed per row, by bands of 0.1 degrees."""
    row = F.floor(F.col(lat) / size).cast("long")
    return _column(lon, row, size).alias("cx"), row.alias("cy")


def _column(lon: str, row: str | Column, size: float) -> Column:
    """Column of a longitude in a row of cells; all of a row have the width of the band its lower edge lies in."""
    band = F.floor((F.col(row) if isinstance(row, str) else row) * size * 10) / 10
    return F.floor(F.col(lon) * F.cos(F.radians(band)) / size).cast("long")


def visits_of(stops_trips: DataFrame) -> DataFrame:
    """(subid, visit, place, start_id, end_id, start_time, end_time, n_stops, n_fixes): contiguous visits.

    ``stops_trips`` is the result of :func:`stops_and_trips`. Successive stops at one place are one visit where a trip
    joins each to the next, that is, where no silence lies between.
    """
    stops = stops_trips.filter("kind = 'stop'")
    joined = stops_trips.filter("kind = 'trip' AND place = to_place").select("subid", F.col("end_id").alias("start_id"), F.lit(0).alias("new"))
    # a window over stops, of which a subject has few beside its fixes
    w = Window.partitionBy("subid").orderBy("start_time", "start_id")
    s = stops.join(joined, ["subid", "start_id"], "left").withColumn("visit", F.sum(F.coalesce("new", F.lit(1))).over(w))
    first, last = F.min(F.struct("start_time", "start_id")), F.max(F.struct("end_time", "end_id"))
    t = s.groupBy("subid", "visit").agg(F.min("place").alias("place"), first.alias("f"), last.alias("l"), F.count("*").alias("n_stops"), F.sum("n_fixes").alias("n_fixes"))
    return t.select("subid", "visit", "place", "f.start_id", "l.end_id", "f.start_time", "l.end_time", "n_stops", "n_fixes")


def stops_and_trips(gps: DataFrame, radius_m: float = 50.0, least_minutes: float = 10.0, silence_minutes: float = 60.0, n_rows: int | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Visits and trips: (subid, kind, start_id, end_id, start_time, end_time, duration_s, distance_m, n_fixes, place, to_place).

    ``gps`` holds fixes with plausible positions (see :func:`plausible_positions`). Kind ``stop``: a longest run of
    successive fixes of a subject, every two at most ``radius_m`` apart, no silence over ``silence_minutes`` inside,
    lasting at least ``least_minutes``; its place is the community of its median. Kind ``trip``: from the last fix of a
    stop to the first of the next, no such silence between; distance is the way along the fixes. Rows with a null
    subid, time, id or position are no fixes. Repeated rows count each. Empty input gives no rows.
    """
    n_rows = gps.count() if n_rows is None else n_rows
    edges, kernel = stop_kernel(radius_m, least_minutes * 60, silence_minutes * 60)
    fixes = fixes_of(gps.filter("lat IS NOT NULL AND lon IS NOT NULL"), "lat", "lon")
    events = materialize(ordered_scan(fixes, FIX_ORDER, _EVENT, kernel, n_rows=n_rows, edges=edges, slice_rows=slice_rows))
    stops = events.filter(F.col("code") == ARRIVAL)
    size = float(np.degrees(20.0 / EARTH_M))
    place = places(stops.select("subid", "lat", "lon", F.col("n").alias("weight")))
    visits = stops.withColumns(dict(zip(("cx", "cy"), _cell("lat", "lon", size), strict=True))).join(place, ["subid", "cx", "cy"]).select("subid", F.col("us").alias("start_us"), F.col("processed_id").alias("start_id"), "end_us", "end_id", "n", "place")
    visits = materialize(visits)
    trips = ordered_scan(events.select("subid", "us", "processed_id", "code", "end_us", "n", "way_m"), ["subid", "us", "processed_id", "code"], _TRIP, _trip_kernel, n_rows=events.count(), breaks=_trip_breaks, slice_rows=slice_rows)
    left, right = visits.select("subid", F.col("end_id").alias("start_id"), "place"), visits.select("subid", F.col("start_id").alias("end_id"), F.col("place").alias("to_place"))
    trips = trips.join(left, ["subid", "start_id"]).join(right, ["subid", "end_id"])
    columns = ["subid", "kind", "start_id", "end_id", "start_us", "end_us", "n", "way_m", "place", "to_place"]
    both = visits.withColumns({"kind": F.lit("stop"), "way_m": F.lit(0.0), "to_place": F.col("place")}).select(*columns).unionByName(trips.withColumn("kind", F.lit("trip")).select(*columns))
    return both.select(F.col("subid").cast(gps.schema["subid"].dataType).alias("subid"), "kind", "start_id", "end_id", from_micros("start_us").alias("start_time"), from_micros("end_us").alias("end_time"), ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"), F.col("way_m").alias("distance_m"), F.col("n").alias("n_fixes"), "place", "to_place")
