"""Implausible readings in step metrics and positions, judged per source.

Each source's series of speeds, and of distances per time, goes through an undecimated wavelet transform (the hat filter
1/4, 1/2, 1/4 at strides 1, 2 and 4); positions are predicted from the path around them at the same strides, by time, as in
lifting on an irregular grid. Detail coefficients are scaled by the median size of their own source and level (kept as a
dense histogram, so no source is gathered). A coefficient beyond so many deviations makes a reading a candidate for a spike;
runs of readings without any change are stuck; bounds catch the impossible. An exact check follows for candidates: a spike
stands only if it contradicts the step it describes (distance, time and positions of that step), a leap of position only if
the path goes out and straight back faster than its source travels.

All but the stuck runs depend on a bounded number of rows around a row. Runs may be as long as the data: what a slice can't
decide about its first and last runs it hands on as pending rows with a summary, and these are joined along the slices.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import MILE_M, np_haversine_m
from ..session import lookup_join, materialize
from .ordered import SLICE_ROWS, Arrays, ordered_scan

#: Histogram of sizes: bin b holds values in [LOW * STEP**b, LOW * STEP**(b+1)); sizes are known to half a step.
BINS, LOW, STEP = 480, 1e-4, 1.05
LEVELS = 3
#: Rows within which a neighbour of a reading is looked for, and rows shown beyond a slice's own: three levels of neighbours.
REACH, HALO = 32, 128


@dataclass(frozen=True)
class ReadingRules:
    """Parameters of :func:`implausible_readings`; speeds in miles an hour, distances in miles."""

    max_speed: float = 150.0  #: no subject moves faster
    spike_scale: float = 6.0  #: a spike's detail coefficient, in deviations of its source and level
    stuck_run: int = 5  #: as many equal non-zero metrics in a row don't come by chance
    stuck_lat_moves: int = 4  #: a latitude unchanged over as many steps that move
    leap_scale: float = 2.0  #: the same for positions, which a moving source's path predicts less well
    leap_fixes: int = 3  #: a leap away and back at a pace that could be holds at most so many fixes
    far_leap_fixes: int = 12  #: one at an impossible pace both ways at most so many
    leap_speed: float = 20.0  #: least mean speed of the way there and back
    leap_share: float = 0.45  #: the same as a share of the source's own high speed
    leap_return: float = 0.4  #: return distance, as a share of the shorter of the two ways


def _bins(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.clip(np.nan_to_num(np.log(np.abs(x) / LOW) / np.log(STEP), nan=0, neginf=0, posinf=BINS - 1), 0, BINS - 1).astype(np.int64)


def _neighbours(subj: np.ndarray, row: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each reading the s-th of the same source before and after it, and whether one exists (edges mirror).

    ``row``: each reading's place among all rows; what is more than ``REACH`` rows away is no neighbour.
    """
    n = len(subj)
    i = np.arange(n)
    a, b = np.maximum(i - s, 0), np.minimum(i + s, n - 1)
    has_a, has_b = (subj[a] == subj) & (a != i) & (row - row[a] <= REACH), (subj[b] == subj) & (b != i) & (row[b] - row <= REACH)
    a, b = np.where(has_a, a, np.where(has_b, b, i)), np.where(has_b, b, np.where(has_a, a, i))
    return a, b, has_a | has_b


def details(x: np.ndarray, subj: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(LEVELS, n) sizes of the detail coefficients of a series of valid readings."""
    out, c = np.zeros((LEVELS, len(x))), x.astype(float)
    for j in range(LEVELS):
        a, b, _ = _neighbours(subj, row, 2**j)
        smooth = (c[a] + 2 * c + c[b]) / 4
        out[j], c = np.abs(c - smooth), smooth
    return out


def _fixes(a: Arrays) -> tuple[np.ndarray, np.ndarray, Arrays]:
    """(first row of each fix, fix of each row, readings of each fix). Rows of one source, time and position whose metrics
    agree where both are present are one fix processed again; its metric is the one that isn't null."""
    n = len(a["us"])
    same = np.zeros(n, bool)
    if n:
        agree = lambda c: (a[c][1:] == a[c][:-1]) | np.isnan(a[c][1:]) | np.isnan(a[c][:-1])
        equal = lambda c: (a[c][1:] == a[c][:-1]) | (np.isnan(a[c][1:]) & np.isnan(a[c][:-1]))
        same[1:] = (a["subid"][1:] == a["subid"][:-1]) & (a["us"][1:] == a["us"][:-1]) & equal("lat") & equal("lon") & agree("speed_mph") & agree("dist_miles")
    start = np.flatnonzero(~same)
    u = {c: a[c][start] for c in a}
    for c in ("speed_mph", "dist_miles"):
        u[c] = np.fmin.reduceat(a[c], start) if n else a[c]
    return start, np.cumsum(~same) - 1, u


def _moves(u: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first fix of its source, miles from the previous fix, whether the subject moved on since then)."""
    m = len(u["us"])
    prev = np.maximum(np.arange(m) - 1, 0)
    first = np.ones(m, bool)
    first[1:] = u["subid"][1:] != u["subid"][:-1]
    pos = np.where(first, np.nan, np_haversine_m(u["lon"][prev], u["lat"][prev], u["lon"], u["lat"]) / MILE_M)
    with np.errstate(invalid="ignore"):
        moved = ~first & ((u["lon"] != u["lon"][prev]) | (np.nan_to_num(u["dist_miles"]) > pos + 2e-4))
    return first, pos, moved


class _Rows:
    """Result rows under construction."""

    def __init__(self) -> None:
        self.rows: dict[str, list] = {f.name: [] for f in READING_SCHEMA}

    def add(self, k: int, **columns) -> None:
        for f in READING_SCHEMA:
            v = columns.get(f.name, "" if isinstance(f.dataType, T.StringType) else 0)
            kind = object if isinstance(f.dataType, T.StringType) else np.int64 if isinstance(f.dataType, T.LongType) else float
            self.rows[f.name].append(np.asarray(v, kind) if np.ndim(v) else np.full(k, v, kind))

    def done(self) -> dict:
        return {c: np.concatenate(v) if v else np.zeros(0) for c, v in self.rows.items()}


MEASURES = ("speed_mph", "dist_miles", "lat")
READING_SCHEMA = T.StructType(
    [T.StructField("subid", T.LongType()), T.StructField("processed_id", T.LongType()), T.StructField("measure", T.StringType()), T.StructField("kind", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("d1", "d2", "d3", "pace")]
    + [T.StructField(c, T.LongType()) for c in ("bin", "count", "slice", "side")]
    + [T.StructField(c, T.DoubleType()) for c in ("value", "lon", "dist")]
)
# sides of a slice's runs: it begins, ends, or is all of one run
HEAD, TAIL, ALL = 0, 1, 2


def stuck_kernel(rules: ReadingRules):
    """Runs of unchanged readings of one slice: rows of runs inside it are decided, those at its ends are pending."""

    def whole(a: Arrays, at: int) -> dict:
        out = _Rows()
        start, fix, u = _fixes(a)
        _, _, moved = _moves(u)
        for name in MEASURES:
            x = u[name]
            have = np.flatnonzero(~np.isnan(x))
            if not len(have):
                continue
            xs, ss = x[have], u["subid"][have]
            new = np.ones(len(xs), bool)
            new[1:] = (xs[1:] != xs[:-1]) | (ss[1:] != ss[:-1])
            run = np.cumsum(new) - 1
            k = int(run[-1]) + 1
            n, moves = np.bincount(run), np.bincount(run, weights=moved[have] & ~new)
            enough = moves >= rules.stuck_lat_moves if name == "lat" else (n >= rules.stuck_run) & (xs[new] != 0)
            inner = np.zeros(k, bool)
            inner[1:-1] = True
            # rows of each run; of a fix processed again each row with a reading counts
            of = np.full(len(u["us"]), -1)
            of[have] = run
            head_fix = np.zeros(len(u["us"]), bool)
            head_fix[have] = new
            rows = np.flatnonzero(of[fix] >= 0)
            rows = rows[~np.isnan(a[name][rows])]
            r = of[fix][rows]
            sure = rows[(inner & enough)[r] & ~head_fix[fix][rows]]
            out.add(len(sure), subid=a["subid"][sure], processed_id=a["processed_id"][sure], measure=name, kind="stuck")
            for end, side in ((0, ALL if k == 1 else HEAD), *(((k - 1, TAIL),) if k > 1 else ())):
                mine = rows[r == end]
                out.add(len(mine), subid=a["subid"][mine], processed_id=a["processed_id"][mine], measure=name, kind="pending", bin=head_fix[fix][mine], slice=at, side=side)
                # a run's first and last fix tell whether it moved over the border
                f, e = have[run == end][[0, -1]]
                edge = {"subid": u["subid"][f], "measure": name, "kind": "edge", "count": n[end], "pace": moves[end], "slice": at, "side": side, "value": xs[run == end][0]}
                out.add(1, **edge, bin=0, lon=u["lon"][f], dist=np.nan_to_num(u["dist_miles"][f]), d1=u["lat"][f])
                out.add(1, **(edge | {"kind": "last"}), bin=1, lon=u["lon"][e], d1=u["lat"][e])
        return out.done()

    return whole


def readings_kernel(rules: ReadingRules):
    def kernel(a: Arrays, own: np.ndarray) -> dict:
        row, fix, u = _fixes(a)
        m, subj, t = len(u["us"]), u["subid"], u["us"] / 1e6
        lat, lon, speed, dist = u["lat"], u["lon"], u["speed_mph"], u["dist_miles"]
        found: dict[str, dict[str, np.ndarray]] = {k: {} for k in MEASURES}
        size = {k: np.zeros((LEVELS, m)) for k in found}
        first, pos, moved = _moves(u)
        prev = np.maximum(np.arange(m) - 1, 0)
        dt = np.where(first, np.nan, t - t[prev])

        # --- positions: bounds, then leaps on the path of what is left
        off = ~(np.abs(lat) <= 90) | ~(np.abs(lon) <= 180)
        p = np.flatnonzero(~off)
        plat, plon, pt, ps, prow = lat[p], lon[p], t[p], subj[p], row[p]
        k = len(p)
        residual = np.zeros(k)
        for s in (1, 2, 4):
            i, j, has = _neighbours(ps, prow, s)
            w = np.where(pt[j] > pt[i], (pt - pt[i]) / np.where(pt[j] > pt[i], pt[j] - pt[i], 1), 0.5).clip(0, 1)
            d = np_haversine_m(plon, plat, plon[i] + w * (plon[j] - plon[i]), plat[i] + w * (plat[j] - plat[i])) / MILE_M
            residual = np.maximum(residual, np.where(has, d, 0))
        size["lat"][0, p] = residual
        step, stime = np.full(k, np.nan), np.full(k, np.nan)
        if k > 1:
            step[1:] = np.where(ps[1:] == ps[:-1], np_haversine_m(plon[:-1], plat[:-1], plon[1:], plat[1:]) / MILE_M, np.nan)
            stime[1:] = np.maximum(pt[1:] - pt[:-1], 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            rate = step / stime * 3600
        leap, leap_pace = np.zeros(k, bool), np.zeros(k)
        # the shortest excursion that explains a jump is taken first
        for length in range(1, rules.far_leap_fixes + 1):
            i = np.arange(1, k - length)
            if not len(i):
                break
            o, e = i + length, i - 1  # first fix after, last before
            with np.errstate(invalid="ignore", divide="ignore"):
                way = (step[i] + step[o]) / (stime[i] + stime[o]) * 3600
                fast = np.maximum(rate[i], rate[o])
                ok = (ps[e] == ps[o]) & (prow[o] - prow[e] <= REACH) & (np.minimum(step[i], step[o]) > 0.05)
                ok &= ((way > rules.leap_speed) | (fast > rules.max_speed)) if length <= rules.leap_fixes else np.minimum(rate[i], rate[o]) > rules.max_speed
            i = i[ok & ~leap[i] & ~leap[o] & ~leap[e]] if length > 1 else i[ok]
            o, e = i + length, i - 1
            back = np_haversine_m(plon[e], plat[e], plon[o], plat[o]) / MILE_M
            near = back <= rules.leap_return * np.minimum(step[i], step[o])
            for q in range(1, length):
                # the fixes away stay together, or leap on among themselves
                near &= (np_haversine_m(plon[i], plat[i], plon[i + q], plat[i + q]) / MILE_M <= 0.5 * np.minimum(step[i], step[o])) | (rate[i + q] > 10 * rules.max_speed)
            i = i[near]
            o = i + length
            v = np.where(np.maximum(rate[i], rate[o]) > rules.max_speed, np.inf, (step[i] + step[o]) / (stime[i] + stime[o]) * 3600)
            for q in range(length):
                leap[i + q] = True
                leap_pace[i + q] = np.maximum(leap_pace[i + q], v)
        off_path, pace = np.zeros(m, bool), np.full(m, np.inf)
        off_path[p] = leap
        pace[p] = np.where(leap, leap_pace, np.inf)
        after = np.zeros(m, bool)  # the step back
        after[1:] = off_path[:-1] & ~off_path[1:] & ~off[1:] & (subj[1:] == subj[:-1])
        found["lat"]["bound"], found["lat"]["spike"] = off, off_path

        # --- what the step itself says: distance over time, and way between the positions
        # a latitude that repeats while its subject moves, within reach, can't be held against the metrics
        new = first | (lat != lat[prev])
        run = np.cumsum(new) - 1
        run_at, run_end = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], m]
        so_far = np.r_[0, np.cumsum(moved & ~new)]
        lo = np.maximum(run_at[run], np.searchsorted(row, row - REACH)) if m else run
        hi = np.minimum(run_end[run], np.searchsorted(row, row + REACH, side="right")) if m else run
        stuck_lat = ~new & (so_far[hi] - so_far[lo] >= rules.stuck_lat_moves)
        with np.errstate(invalid="ignore", divide="ignore"):
            v_pos, v_dist = pos / dt * 3600, dist / dt * 3600
            slack = 0.03 + 0.25 / np.maximum(dt, 1) * 3600 * 1e-3
            odd_v_pos = ~(np.abs(speed - v_pos) <= slack)
            odd_v_dist = ~(np.abs(speed - v_dist) <= slack)
            odd_d_pos = ~(np.abs(dist - pos) <= 2.5e-4)
        held = off | stuck_lat | off_path
        held_step = held | np.where(first, False, held[prev])
        followed_leap = (off_path & ~np.where(first, False, off_path[prev])) | after
        for name, x, odd in (("speed_mph", speed, odd_v_dist & (odd_v_pos | held_step)), ("dist_miles", dist, odd_v_dist & (odd_d_pos | held_step))):
            have = np.flatnonzero(~np.isnan(x))
            xs = x[have]
            # distances are judged by what is covered in the time since the previous fix
            per_hour = xs if name == "speed_mph" else xs / np.nan_to_num(np.maximum(dt[have], 1), nan=60.0) * 3600
            size[name][:, have] = details(per_hour, subj[have], row[have])
            bound = np.zeros(m, bool)
            bound[have] = (xs < 0) | (per_hour > rules.max_speed)
            with np.errstate(invalid="ignore"):
                # of a distance and a speed that contradict each other the one that agrees with the positions is right;
                # where positions can't tell, the larger is wrong
                right = np.abs(x - (v_pos if name == "speed_mph" else pos)) <= (slack if name == "speed_mph" else 2.5e-4)
                larger = np.nan_to_num(x) > np.abs(np.nan_to_num(v_dist)) if name == "speed_mph" else np.nan_to_num(v_dist) > np.abs(np.nan_to_num(speed))
            spike = odd & ~first & ~np.isnan(x) & np.where(held_step, larger, ~right)
            follows = followed_leap & right & ~np.isnan(x)
            found[name] |= {"bound": bound & ~follows, "spike": spike, "leap": follows}

        # --- hand over: flagged rows, and each source's histograms
        out = _Rows()
        for measure, kinds in found.items():
            for kind, hit in kinds.items():
                at = np.flatnonzero(hit[fix] & own)
                at = at[~np.isnan(a[measure][at])]
                f = fix[at]
                # what followed a leap is judged by the leap
                of = np.where(after[f] & ~off_path[f], np.maximum(f - 1, 0), f) if kind == "leap" else f
                judged = size["lat"] if kind == "leap" else size[measure]
                positional = kind == "leap" or (measure == "lat" and kind == "spike")
                out.add(len(at), subid=a["subid"][at], processed_id=a["processed_id"][at], measure=measure, kind=kind, d1=judged[0, of], d2=judged[1, of], d3=judged[2, of], pace=pace[of] if positional else np.inf)
        mine = own[row] if m else np.zeros(0, bool)
        series = [("lat", 0, size["lat"][0], ~off), ("usual", 0, np.abs(np.nan_to_num(speed)), ~np.isnan(speed))]
        series += [(name, j, size[name][j], ~np.isnan(u[name])) for name in ("speed_mph", "dist_miles") for j in range(LEVELS)]
        for measure, level, values, ok in series:
            ok = ok & mine
            sid, code = np.unique(subj[ok], return_inverse=True)
            dense = np.bincount(code * BINS + _bins(values[ok]), minlength=len(sid) * BINS)
            at = np.flatnonzero(dense)
            out.add(len(at), subid=sid[at // BINS], measure=measure, kind="hist", side=level, bin=at % BINS, count=dense[at])
        return out.done()

    return kernel


def fixes_of(gps: DataFrame, *columns: str) -> DataFrame:
    """The columns an ordered scan of fixes needs; rows without source, time or id are no fixes and are left out."""
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(time AS timestamp_ntz))").alias("us")
    return gps.filter("subid IS NOT NULL AND time IS NOT NULL AND processed_id IS NOT NULL").select(F.col("subid").cast("long").alias("subid"), us, F.col("processed_id").cast("long").alias("processed_id"), *columns)


FIX_ORDER = ["subid", "us", "processed_id"]


def _stuck_at_borders(scanned: DataFrame, rules: ReadingRules) -> DataFrame:
    """(subid, processed_id, measure) of stuck readings in runs that touch a slice's end.

    The summaries of such runs, two a slice and measure, are chained along the slices; each pending row then learns from
    its slice and side how long its whole run is.
    """
    w = Window.partitionBy("measure").orderBy("slice", "side")
    last = scanned.filter("kind = 'last'").select("measure", "slice", "side", F.col("lon").alias("last_lon"), F.col("d1").alias("last_lat"))
    edge = scanned.filter("kind = 'edge'").join(last, ["measure", "slice", "side"])
    lag = lambda c: F.lag(c).over(w)
    goes_on = F.coalesce((F.col("side") != TAIL) & (lag("slice") != F.col("slice")) & (lag("subid") == F.col("subid")) & (lag("value") == F.col("value")), F.lit(False))
    # a latitude that goes on over the border has moved if its longitude has, or if the metric says so
    moved = goes_on & ((lag("last_lon") != F.col("lon")) | (F.col("dist") > 2e-4))
    edge = edge.withColumns({"goes_on": goes_on, "part": F.when(goes_on, 0).otherwise(1), "over": F.when(moved, 1).otherwise(0)})
    edge = edge.withColumn("chain", F.sum("part").over(w))
    total = Window.partitionBy("measure", "chain")
    n, moves = F.sum("count").over(total), F.sum(F.col("pace") + F.col("over")).over(total)
    stuck = F.when(F.col("measure") == "lat", moves >= rules.stuck_lat_moves).otherwise((n >= rules.stuck_run) & (F.col("value") != 0))
    decided = edge.select("measure", "slice", "side", "goes_on", stuck.alias("stuck")).filter("stuck").drop("stuck")
    pending = scanned.filter("kind = 'pending'").select("subid", "processed_id", "measure", "slice", "side", "bin")
    return lookup_join(pending, decided, ["measure", "slice", "side"], spread="processed_id").filter("bin = 0 OR goes_on").select("subid", "processed_id", "measure")


def implausible_readings(gps: DataFrame, rules: ReadingRules = ReadingRules(), n_rows: int | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(subid, processed_id, measure, kind) of every reading of speed_mph, dist_miles or lat that can't be right.

    ``kind`` is ``bound``, ``stuck``, ``spike`` or ``leap`` (a metric that followed a leap of position); a reading that
    is wrong in several ways comes out once, with the first of these. Null readings are never reported, null subid or
    time leaves a row out, a null position counts as out of bounds only if lat itself isn't null. Rows processed twice
    are judged once and reported under each id. Empty input gives no rows. The rows don't depend on ``slice_rows``.
    """
    fixes = fixes_of(gps, "lat", "lon", "speed_mph", "dist_miles")
    n_rows = gps.count() if n_rows is None else n_rows
    scanned = materialize(ordered_scan(fixes, FIX_ORDER, READING_SCHEMA, readings_kernel(rules), n_rows=n_rows, halo=HALO, whole=stuck_kernel(rules), cut=FIX_ORDER[:2], slice_rows=slice_rows))
    hist = scanned.filter("kind = 'hist'").groupBy("subid", "measure", "side", "bin").agg(F.sum("count").alias("n"))
    # the size of a source's median coefficient by level, and its 99th percentile of speed: at most BINS rows a source and series
    dense = hist.groupBy("subid", "measure", "side").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("h"), F.sum("n").alias("total"))

    def quantile(q: float):
        walk = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).cast("long").alias("at")), lambda acc, x: F.struct((acc.seen + x.n).alias("seen"), F.when((acc.at < 0) & (acc.seen + x.n >= F.col("total") * q), x.bin).otherwise(acc.at).alias("at")))
        return F.lit(LOW) * F.pow(F.lit(STEP), walk.at + 0.5)

    mid = [F.max(F.when((F.col("measure") == m) & (F.col("side") == j), quantile(0.5) * 1.4826)).alias(f"{m}_{j}") for m in ("speed_mph", "dist_miles") for j in range(LEVELS)]
    source = dense.groupBy("subid").agg(*mid, F.max(F.when(F.col("measure") == "lat", quantile(0.5) * 1.4826)).alias("lat_0"), F.max(F.when(F.col("measure") == "usual", quantile(0.99))).alias("high"))
    source = materialize(source)
    cases = lookup_join(scanned.filter("kind IN ('bound', 'spike', 'leap')"), source, ["subid"], spread="processed_id", width=128, how="left")
    beyond = lambda d, s, times=rules.spike_scale: F.coalesce(F.col(d) > times * F.col(s), F.lit(False))
    metric = lambda m: beyond("d1", f"{m}_0") | beyond("d2", f"{m}_1") | beyond("d3", f"{m}_2")
    positional = beyond("d1", "lat_0", rules.leap_scale) & (F.col("pace") > F.greatest(F.lit(rules.leap_speed), rules.leap_share * F.coalesce("high", F.lit(0.0))))
    spike = F.when((F.col("kind") == "leap") | (F.col("measure") == "lat"), positional).when(F.col("measure") == "speed_mph", metric("speed_mph")).otherwise(metric("dist_miles"))
    kept = cases.filter((F.col("kind") == "bound") | spike).select("subid", "processed_id", "measure", "kind")
    stuck = scanned.filter("kind = 'stuck'").select("subid", "processed_id", "measure").unionByName(_stuck_at_borders(scanned, rules)).withColumn("kind", F.lit("stuck"))
    order = F.array_position(F.array(*map(F.lit, ("bound", "stuck", "spike", "leap"))), F.col("kind"))
    return kept.unionByName(stuck).groupBy("processed_id", "measure").agg(F.min("subid").alias("subid"), F.min(F.struct(order.alias("o"), "kind")).alias("k")).select("subid", "processed_id", "measure", "k.kind")
