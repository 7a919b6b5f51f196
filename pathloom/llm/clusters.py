"""Similarity clusters of fixes per subject, set off by distance, by Gaussian mixtures.

Fixes are pooled to distinct positions and these are cut into tiles with a margin, so a subject with a third of all rows is
spread over its tiles. In a tile positions are reduced to small cells with weight, mean and scatter. Cells within the
separation distance of each other form a neighbourhood; its cells are standardised and a weighted mixture with regularised
covariance is fitted by expectation-maximisation, starting from one component per local peak. An information criterion on
the assigned data decides which components stay apart: the covariance's floor is half the largest diameter, below which
the criterion never pays for two. A cell belongs to the component most responsible for it, and the cells of a component
are a candidate. Candidates then pass the exact check of size, diameter and separation (nothing else in the
neighbourhood). The densest fixes of its component stand for a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, np_haversine_m
from ..operators.graph import components
from ..session import lookup_join, materialize

#: Cell width in metres; tile size in degrees of latitude and longitude.
CELL, TILE_LAT, TILE_LON = 25.0, 0.02, 0.03
#: Positions a task gets on average.
TASK_SPOTS = 100_000
_ROW = 512  # cells of a tile's row in a key


@dataclass(frozen=True)
class ClusterRules:
    least: int = 10  #: fixes
    diameter_m: float = 50.0  #: every two members at most so far apart
    apart_m: float = 80.0  #: every other fix of the subject farther than this from each member
    spread_m: float = 25.0  #: regularisation: no component is narrower; half the diameter keeps a narrow place in one
    rounds: int = 6  #: of expectation-maximisation
    typical: int = 3  #: fixes that represent a cluster


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the convex hull's corners (monotone chain)."""
    order = np.lexsort((y, x))
    if len(order) < 3:
        return order
    # only the extremes of each distinct x can be corners
    xs = x[order]
    first = np.r_[True, xs[1:] != xs[:-1]]
    last = np.r_[first[1:], True]
    order = order[first | last]

    def chain(seq):
        out: list[int] = []
        for i in seq:
            while len(out) > 1 and (x[out[-1]] - x[out[-2]]) * (y[i] - y[out[-2]]) - (y[out[-1]] - y[out[-2]]) * (x[i] - x[out[-2]]) <= 0:
                out.pop()
            out.append(i)
        return out

    seq = order.tolist()
    return np.unique(chain(seq) + chain(seq[::-1]))


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row i with every index of lo[i]..hi[i]-1."""
    n = np.maximum(hi - lo, 0)
    left = np.repeat(np.arange(len(lo)), n)
    return left, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _mixture(comp: np.ndarray, w: np.ndarray, mx: np.ndarray, my: np.ndarray, sxx: np.ndarray, sxy: np.ndarray, syy: np.ndarray, a: np.ndarray, b: np.ndarray, touch: np.ndarray, floor: np.ndarray, rules: ClusterRules) -> tuple[np.ndarray, np.ndarray]:
    """(component of each cell, its log density there) of a mixture fitted to each neighbourhood of weighted cells.

    ``a``, ``b``: pairs of cells of a neighbourhood near each other, both ways and with themselves; ``touch``: those next
    to each other, of which the heaviest seeds a component. Coordinates come
    standardised per neighbourhood; ``sxx``, ``sxy``, ``syy`` are the scatter within cells, ``floor`` what is added to
    the variances of a component at each cell, in the same units. The first is the seed cell of the component, or the
    cell itself where it has none.
    """
    n = len(w)
    top = np.zeros(n)
    np.maximum.at(top, a[touch], w[b[touch]])
    peak = w >= top
    # of equal neighbours the first is the peak
    tie = touch & (a != b) & (w[a] == w[b]) & peak[a] & peak[b]
    peak[np.maximum(a, b)[tie]] = False
    seeds = np.flatnonzero(peak)
    if not len(seeds):
        return np.arange(n), np.zeros(n)
    number = np.full(n, -1)
    number[seeds] = np.arange(len(seeds))
    use = number[b] >= 0
    cell, k = a[use], number[b[use]]
    lone = np.setdiff1d(np.arange(n), cell)  # cells without a peak near go to their neighbourhood's heaviest
    if len(lone):
        order = np.lexsort((-w[seeds], comp[seeds]))
        heads = order[np.r_[True, comp[seeds][order][1:] != comp[seeds][order][:-1]]]
        at = np.searchsorted(comp[seeds][heads], comp[lone])
        ok = (at < len(heads)) & (comp[seeds][heads[np.minimum(at, len(heads) - 1)]] == comp[lone])
        cell, k = np.r_[cell, lone[ok]], np.r_[k, heads[at[ok]]]
    m = len(seeds)
    ux, uy = mx[seeds].copy(), my[seeds].copy()
    reg = floor[seeds]
    vxx, vyy, vxy = 1.0 + reg, 1.0 + reg, np.zeros(m)
    share = np.maximum(w[seeds], 1e-9)
    total = np.zeros(n)
    np.add.at(total, comp, w)
    logp = np.zeros(len(cell))
    for _ in range(rules.rounds):
        det = vxx * vyy - vxy * vxy
        dx, dy = mx[cell] - ux[k], my[cell] - uy[k]
        dist = (vyy[k] * (dx * dx + sxx[cell]) - 2 * vxy[k] * (dx * dy + sxy[cell]) + vxx[k] * (dy * dy + syy[cell])) / det[k]
        logp = np.log(share[k] / total[comp[cell]]) - 0.5 * (np.log(det[k]) + dist)
        best = np.full(n, -np.inf)
        np.maximum.at(best, cell, logp)
        r = np.exp(logp - best[cell])
        r *= w[cell] / np.bincount(cell, weights=r, minlength=n)[cell]
        s = np.maximum(np.bincount(k, weights=r, minlength=m), 1e-9)
        share = s
        ux, uy = np.bincount(k, weights=r * mx[cell], minlength=m) / s, np.bincount(k, weights=r * my[cell], minlength=m) / s
        dx, dy = mx[cell] - ux[k], my[cell] - uy[k]
        vxx = np.bincount(k, weights=r * (dx * dx + sxx[cell]), minlength=m) / s + reg
        vyy = np.bincount(k, weights=r * (dy * dy + syy[cell]), minlength=m) / s + reg
        vxy = np.bincount(k, weights=r * (dx * dy + sxy[cell]), minlength=m) / s
    order = np.lexsort((-logp, cell))
    pick = order[np.r_[True, cell[order][1:] != cell[order][:-1]]]
    member, density = np.arange(n), np.full(n, -np.inf)
    member[cell[pick]], density[cell[pick]] = seeds[k[pick]], logp[pick]
    # Schwarz criterion on the assigned data: two components near each other stay apart only if that is worth their parameters
    ka, kb = number[member[a]], number[member[b]]
    near = (ka >= 0) & (kb >= 0) & (ka < kb)
    pairs = np.unique(np.stack([ka[near], kb[near]], axis=1), axis=0) if near.any() else np.zeros((0, 2), np.int64)
    i, j = pairs.T
    si, sj = share[i], share[j]
    s = si + sj
    cx, cy = (si * ux[i] + sj * ux[j]) / s, (si * uy[i] + sj * uy[j]) / s
    mm = lambda v, p, q: (si * (v[i] + (p[i] - (cx if p is ux else cy)) * (q[i] - (cx if q is ux else cy))) + sj * (v[j] + (p[j] - (cx if p is ux else cy)) * (q[j] - (cx if q is ux else cy)))) / s
    det1 = mm(vxx, ux, ux) * mm(vyy, uy, uy) - mm(vxy, ux, uy) ** 2
    gain = si * (np.log(si / s) - 0.5 * np.log((vxx * vyy - vxy**2)[i])) + sj * (np.log(sj / s) - 0.5 * np.log((vxx * vyy - vxy**2)[j])) + 0.5 * s * np.log(np.maximum(det1, 1e-300))
    merge = 2 * gain <= 6 * np.log(np.maximum(s, 2))
    root = components(m, i[merge], j[merge])
    got = number[member] >= 0
    member[got] = seeds[root[number[member[got]]]]
    return member, density


def tile_clusters(a: dict[str, np.ndarray], rules: ClusterRules) -> dict[str, list]:
    """Clusters owned by the tiles of a partition; ``a``: subid, tx, ty, lat, lon, n, pid of distinct positions."""
    out: dict[str, list] = {c: [] for c in ("subid", "cluster_key", "size", "lat0", "lat1", "lon0", "lon1", "typical", "n_components")}
    if not len(a["n"]):
        return out
    order = np.lexsort((a["tx"], a["ty"], a["subid"]))
    a = {c: v[order] for c, v in a.items()}
    new = np.r_[True, (a["tx"][1:] != a["tx"][:-1]) | (a["ty"][1:] != a["ty"][:-1]) | (a["subid"][1:] != a["subid"][:-1])]
    g = np.cumsum(new) - 1
    enough = np.bincount(g, weights=a["n"]) >= rules.least
    keep = enough[g]
    a, g = {c: v[keep] for c, v in a.items()}, g[keep]
    if not len(g):
        return out
    mid = (a["ty"] + 0.5) * TILE_LAT
    x = np.radians(a["lon"] - a["tx"] * TILE_LON) * EARTH_M * np.cos(np.radians(mid))
    y = np.radians(a["lat"] - a["ty"] * TILE_LAT) * EARTH_M
    cx, cy = np.floor(x / CELL).astype(np.int64) + 16, np.floor(y / CELL).astype(np.int64) + 16
    key = (g * _ROW + cy) * _ROW + cx
    order = np.argsort(key, kind="stable")
    a, x, y, key = {c: v[order] for c, v in a.items()}, x[order], y[order], key[order]
    s = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    keys, cell_of = key[s], np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    n = len(keys)
    x0, x1, y0, y1 = np.minimum.reduceat(x, s), np.maximum.reduceat(x, s), np.minimum.reduceat(y, s), np.maximum.reduceat(y, s)
    w = np.add.reduceat(a["n"], s).astype(float)

    # --- neighbourhoods: cells whose positions may lie within the separation distance
    reach = int(np.ceil(rules.apart_m / CELL))
    left, right = [], []
    for dy in range(reach + 1):
        lo = np.searchsorted(keys, keys + dy * _ROW + (1 if dy == 0 else -reach))
        hi = np.searchsorted(keys, keys + dy * _ROW + reach, side="right")
        i, j = _expand(lo, hi)
        gx, gy = np.maximum(0, np.maximum(x0[j] - x1[i], x0[i] - x1[j])), np.maximum(0, np.maximum(y0[j] - y1[i], y0[i] - y1[j]))
        ok = gx * gx + gy * gy <= rules.apart_m**2 * 1.001
        left.append(i[ok])
        right.append(j[ok])
    i, j = np.concatenate(left), np.concatenate(right)
    rep = np_haversine_m(a["lon"][s[i]], a["lat"][s[i]], a["lon"][s[j]], a["lat"][s[j]])
    sure = rep <= rules.apart_m
    comp = components(n, i[sure], j[sure])
    open_i, open_j = i[~sure], j[~sure]
    ends = np.r_[s[1:], len(x)]
    settled = np.zeros(len(open_i), bool)
    # links that the cells' extents leave open are decided on positions, where they could matter
    while True:
        cw, bx = np.bincount(comp, weights=w, minlength=n), [np.full(n, v) for v in (np.inf, -np.inf, np.inf, -np.inf)]
        np.minimum.at(bx[0], comp, x0)
        np.maximum.at(bx[1], comp, x1)
        np.minimum.at(bx[2], comp, y0)
        np.maximum.at(bx[3], comp, y1)
        tight = (bx[1] - bx[0] <= rules.diameter_m * 1.001) & (bx[3] - bx[2] <= rules.diameter_m * 1.001)
        ci, cj = comp[open_i], comp[open_j]
        todo = np.flatnonzero(~settled & (ci != cj) & ((tight[ci] & tight[cj]) | (tight[ci] & (cw[ci] >= rules.least)) | (tight[cj] & (cw[cj] >= rules.least))))
        if not len(todo):
            break
        settled[todo] = True
        true = [t for t in todo.tolist() if _within(a, x, y, (s[open_i[t]], ends[open_i[t]]), (s[open_j[t]], ends[open_j[t]]), rules.apart_m)]
        if not true:
            break
        both_i, both_j = np.r_[i[sure], open_i[true]], np.r_[j[sure], open_j[true]]
        i, j, sure = np.r_[i, open_i[true]], np.r_[j, open_j[true]], np.r_[sure, np.ones(len(true), bool)]
        comp = components(n, both_i, both_j)

    # --- mixtures on the neighbourhoods that hold enough fixes
    heavy = np.bincount(comp, weights=w, minlength=n)[comp] >= rules.least
    at = np.flatnonzero(heavy)
    if not len(at):
        return out
    back = np.full(n, -1)
    back[at] = np.arange(len(at))
    pn = a["n"].astype(float)
    total = np.add.reduceat(pn, s)
    mx, my = np.add.reduceat(pn * x, s) / total, np.add.reduceat(pn * y, s) / total
    dxx, dyy = x - mx[cell_of], y - my[cell_of]
    sxx, sxy, syy = (np.add.reduceat(pn * q, s) / total for q in (dxx * dxx, dxx * dyy, dyy * dyy))
    # standardised: from the neighbourhood's centre, in its deviations (a cell's width at least)
    cw = np.maximum(np.bincount(comp, weights=w, minlength=n), 1e-9)
    zx, zy = mx - (np.bincount(comp, weights=w * mx, minlength=n) / cw)[comp], my - (np.bincount(comp, weights=w * my, minlength=n) / cw)[comp]
    unit2 = np.maximum(CELL**2, np.bincount(comp, weights=w * (zx * zx + zy * zy + sxx + syy), minlength=n) / cw / 2)[comp]
    zx, zy, sxx, sxy, syy = zx / np.sqrt(unit2), zy / np.sqrt(unit2), sxx / unit2, sxy / unit2, syy / unit2
    near = heavy[i] & heavy[j] & (comp[i] == comp[j]) & (np.abs(keys[i] // _ROW - keys[j] // _ROW) <= 2) & (np.abs(keys[i] % _ROW - keys[j] % _ROW) <= 2)
    pi, pj = back[i[near]], back[j[near]]
    touch = (np.abs(keys[i] // _ROW - keys[j] // _ROW) <= 1)[near] & (np.abs(keys[i] % _ROW - keys[j] % _ROW) <= 1)[near]
    every = np.arange(len(at))
    member, density = _mixture(back[comp[at]], w[at], zx[at], zy[at], sxx[at], sxy[at], syy[at], np.r_[pi, pj, every], np.r_[pj, pi, every], np.r_[touch, touch, every >= 0], (rules.spread_m**2 / unit2)[at], rules)

    # --- a component's cells are a candidate; exact check: alone in its neighbourhood, and its diameter
    label = np.full(n, -1)
    label[at] = at[member]
    n_comp = np.bincount(back[comp[at]][np.unique(member)], minlength=len(at))
    alone = np.zeros(n, bool)
    alone[at] = np.bincount(label[at], minlength=n)[label[at]] == np.bincount(comp, minlength=n)[comp[at]]
    c_of = label[cell_of]
    fine = alone & tight_of(np.where(label < 0, np.arange(n), label), x0, x1, y0, y1, rules.diameter_m)
    pick = np.flatnonzero(fine[cell_of])
    pick = pick[np.argsort(c_of[pick], kind="stable")]
    if not len(pick):
        return out
    cuts = np.flatnonzero(np.r_[True, c_of[pick][1:] != c_of[pick][:-1]])
    for p, q in zip(cuts, np.r_[cuts[1:], len(pick)], strict=True):
        rows = pick[p:q]
        first = rows[np.argmin(a["pid"][rows])]
        if np.floor(a["lat"][first] / TILE_LAT) != a["ty"][first] or np.floor(a["lon"][first] / TILE_LON) != a["tx"][first]:
            continue  # another tile's
        lat, lon = a["lat"][rows], a["lon"][rows]
        if np.hypot(x[rows].max() - x[rows].min(), y[rows].max() - y[rows].min()) > rules.diameter_m * 0.999:
            h = hull(x[rows], y[rows])
            if max(np_haversine_m(lon[h], lat[h], lon[k], lat[k]).max() for k in h) > rules.diameter_m:
                continue
        cells = back[cell_of[rows]]
        dense = np.lexsort((a["pid"][rows], -a["n"][rows], -density[cells]))[: rules.typical]
        for c, v in zip(out, (a["subid"][first], a["pid"][first], a["n"][rows].sum(), lat.min(), lat.max(), lon.min(), lon.max(), a["pid"][rows[dense]].tolist(), n_comp[back[comp[cell_of[first]]]]), strict=True):
            out[c].append(v)
    return out


def tight_of(comp: np.ndarray, x0, x1, y0, y1, limit: float) -> np.ndarray:
    n = len(comp)
    bx = [np.full(n, v) for v in (np.inf, -np.inf, np.inf, -np.inf)]
    np.minimum.at(bx[0], comp, x0)
    np.maximum.at(bx[1], comp, x1)
    np.minimum.at(bx[2], comp, y0)
    np.maximum.at(bx[3], comp, y1)
    return ((bx[1] - bx[0] <= limit * 1.001) & (bx[3] - bx[2] <= limit * 1.001))[comp]


def _within(a: dict, x: np.ndarray, y: np.ndarray, p: tuple[int, int], q: tuple[int, int], limit: float) -> bool:
    """Whether two cells have positions within ``limit`` of each other; only positions near the other cell are compared."""
    i, j = np.arange(*p), np.arange(*q)
    for _ in range(3):
        for one, other in ((0, 1), (1, 0)):
            u, v = (i, j) if one == 0 else (j, i)
            if not len(u) or not len(v):
                return False
            gx = np.maximum(0, np.maximum(x[v].min() - x[u], x[u] - x[v].max()))
            gy = np.maximum(0, np.maximum(y[v].min() - y[u], y[u] - y[v].max()))
            u = u[gx * gx + gy * gy <= (limit * 1.001) ** 2]
            i, j = (u, j) if one == 0 else (i, u)
    return any((np_haversine_m(a["lon"][k], a["lat"][k], a["lon"][j], a["lat"][j]) <= limit).any() for k in i.tolist()) if len(j) else False


def place_clusters(gps: DataFrame, rules: ClusterRules = ClusterRules()) -> DataFrame:
    """One row per cluster: (subid, cluster_key, size, lat0, lat1, lon0, lon1, typical, n_components).

    ``gps`` holds fixes with plausible positions. A cluster is a set of at least ``least`` fixes of one subject, every
    two at most ``diameter_m`` apart, every other fix of the subject more than ``apart_m`` from each of them; sets of
    fixes that aren't set off like this are no clusters. ``cluster_key`` is the smallest processed_id, ``typical`` the
    ids of fixes where the mixture is densest, lat0..lon1 the cluster's extent, in which no other fix of the subject can
    lie. Null subid, id or position: no fix. Repeated rows count each. Empty input gives no rows.
    """
    ok = "subid IS NOT NULL AND processed_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)"
    spots = gps.filter(ok).groupBy(F.col("subid").cast("long").alias("subid"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).agg(F.count("*").alias("n"), F.min("processed_id").cast("long").alias("pid"))
    margin = float(np.degrees((rules.diameter_m + rules.apart_m) * 1.15 / EARTH_M))
    wide = F.lit(margin) / F.greatest(F.cos(F.radians(F.abs("lat") + 0.1)), F.lit(0.02))
    tiles = lambda c, m, size: F.explode(F.sequence(F.floor((F.col(c) - m) / size).cast("long"), F.floor((F.col(c) + m) / size).cast("long")))
    spots = materialize(spots)
    parts = max(1, spots.count() // TASK_SPOTS, spots.sparkSession.sparkContext.defaultParallelism)
    tiled = spots.withColumn("ty", tiles("lat", F.lit(margin), TILE_LAT)).withColumn("tx", tiles("lon", wide, TILE_LON)).repartition(parts, "subid", "ty", "tx")

    schema = "subid long, cluster_key long, size long, lat0 double, lat1 double, lon0 double, lon1 double, typical array<long>, n_components long"
    types = [pa.int64()] * 3 + [pa.float64()] * 4 + [pa.list_(pa.int64()), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        table = pa.Table.from_batches(kept)
        got = tile_clusters({c: table.column(c).to_numpy() for c in table.column_names}, rules)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(got.values(), types, strict=True)], names=list(got))

    return tiled.select("subid", "ty", "tx", "lat", "lon", "n", "pid").mapInArrow(run, schema)


def cluster_members(gps: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_key, processed_id) of every member.

    A cluster's extent is closed to its subject's other fixes, so members are the fixes inside it; clusters are written
    to the cells they touch and joined by cell, sent to all tasks only if their measured size allows it; otherwise the
    fixes of a subject and cell are spread over salted parts.
    """
    size = 0.002
    clusters = materialize(clusters.select("subid", "cluster_key", "lat0", "lat1", "lon0", "lon1"))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size).cast("long"), F.floor(F.col(hi) / size).cast("long")))
    cells = clusters.withColumn("iy", span("lat0", "lat1")).withColumn("ix", span("lon0", "lon1"))
    fixes = gps.filter("lat IS NOT NULL AND lon IS NOT NULL AND subid IS NOT NULL AND processed_id IS NOT NULL").select(F.col("subid").cast("long").alias("subid"), "processed_id", "lat", "lon", F.floor(F.col("lat") / size).cast("long").alias("iy"), F.floor(F.col("lon") / size).cast("long").alias("ix"))
    found = lookup_join(fixes, cells, ["subid", "iy", "ix"], spread="processed_id", width=96)
    return found.filter("lat BETWEEN lat0 AND lat1 AND lon BETWEEN lon0 AND lon1").select("cluster_key", "processed_id")
