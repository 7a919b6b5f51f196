"""Polygons as well-known text: measures, clipping to grid cells, overlay areas, simplification, and map object rules.

Rings count even-odd, as in the containment join: holes and parts need no orientation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M
from ..functions.taxonomy import POI_CLASSES
from .proximity import in_regions, rings_of


def _signed(r: np.ndarray) -> float:
    x, y = r[:, 0] - r[0, 0], r[:, 1] - r[0, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def _depth_signs(rings: list[np.ndarray]) -> list[int]:
    """1 for rings that add area, -1 for those that take it away: by how many other rings hold their first corner's ring."""
    signs = []
    for i, r in enumerate(rings):
        x, y = r[:-1].mean(0) if len(r) == 4 else (r[0] + r[1]) / 2
        depth = 0
        for j, o in enumerate(rings):
            if i != j:
                a, b = o[:-1], o[1:]
                over = (a[:, 0] > x) != (b[:, 0] > x)
                with np.errstate(divide="ignore", invalid="ignore"):
                    depth += int(np.count_nonzero(over & (a[:, 1] + (x - a[:, 0]) / (b[:, 0] - a[:, 0]) * (b[:, 1] - a[:, 1]) > y)) & 1)
        signs.append(-1 if depth & 1 else 1)
    return signs


def area_of(rings: list[np.ndarray]) -> float:
    """Planar area in squared units of the coordinates."""
    return sum(s * abs(_signed(r)) for s, r in zip(_depth_signs(rings), rings, strict=True))


def centroid_of(rings: list[np.ndarray]) -> tuple[float, float]:
    """Area centroid; of an area of zero the mean corner."""
    if not rings:
        return math.nan, math.nan
    total, cx, cy = 0.0, 0.0, 0.0
    for s, r in zip(_depth_signs(rings), rings, strict=True):
        x, y = r[:, 0] - r[0, 0], r[:, 1] - r[0, 1]
        cross = x[:-1] * y[1:] - x[1:] * y[:-1]
        a = cross.sum() / 2
        w = s * abs(a)
        if a:
            cx += w * (((x[:-1] + x[1:]) * cross).sum() / (6 * a) + r[0, 0])
            cy += w * (((y[:-1] + y[1:]) * cross).sum() / (6 * a) + r[0, 1])
        total += w
    if not total:
        every = np.vstack([r[:-1] for r in rings])
        return float(every[:, 0].mean()), float(every[:, 1].mean())
    return cx / total, cy / total


def to_mercator(r: np.ndarray) -> np.ndarray:
    return np.stack([EARTH_M * np.radians(r[:, 0]), EARTH_M * np.log(np.tan(np.pi / 4 + np.radians(r[:, 1]) / 2))], 1)


def sphere_area_of(rings: list[np.ndarray]) -> float:
    """Square metres on the sphere: the cylindrical equal-area projection keeps areas (edges straight in it)."""
    return area_of([np.stack([EARTH_M * np.radians(r[:, 0]), EARTH_M * np.sin(np.radians(r[:, 1]))], 1) for r in rings])


def clip_ring(r: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """A closed ring cut to a box, edge by edge; empty (0 rows) outside. Joining seams along the box have no area."""
    x0, y0, x1, y1 = box
    for axis, limit, keep_low in ((0, x0, False), (0, x1, True), (1, y0, False), (1, y1, True)):
        if len(r) < 4:
            return np.zeros((0, 2))
        inside = r[:, axis] <= limit if keep_low else r[:, axis] >= limit
        if inside.all():
            continue
        out = []
        for (p, q), (i, j) in zip(zip(r[:-1], r[1:], strict=True), zip(inside[:-1], inside[1:], strict=True), strict=True):
            if i:
                out.append(p)
            if i != j:
                t = (limit - p[axis]) / (q[axis] - p[axis])
                cut = p + t * (q - p)
                cut[axis] = limit
                out.append(cut)
        r = np.array([*out, out[0]]) if out else np.zeros((0, 2))
    return r


def overlay_areas(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[float, float, float]:
    """(area of a and b, of a without b, of b without a): exact, by vertical slabs between all corners and crossings."""

    def edges(rings):
        e = np.vstack([np.hstack([r[:-1], r[1:]]) for r in rings]) if rings else np.zeros((0, 4))
        e = e[e[:, 0] != e[:, 2]]
        return np.where((e[:, 0] > e[:, 2])[:, None], e[:, [2, 3, 0, 1]], e)

    ea, eb = edges(a), edges(b)
    e, mine = np.vstack([ea, eb]), np.r_[np.zeros(len(ea), int), np.ones(len(eb), int)]
    if not len(e):
        return 0.0, 0.0, 0.0
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    i, j = np.triu_indices(len(e), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (e[j, 1] - slope[j] * e[j, 0] - e[i, 1] + slope[i] * e[i, 0]) / (slope[i] - slope[j])
    hit = np.isfinite(x) & (x > np.maximum(e[i, 0], e[j, 0])) & (x < np.minimum(e[i, 2], e[j, 2]))
    cuts = np.unique(np.r_[e[:, 0], e[:, 2], x[hit]])
    out = np.zeros(3)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        mid = (lo + hi) / 2
        on = (e[:, 0] <= lo) & (e[:, 2] >= hi)
        y = e[on, 1] + slope[on] * (mid - e[on, 0])
        order = np.argsort(y)
        y, who = y[order], mine[on][order]
        in_a, in_b = np.cumsum(who == 0) % 2 == 1, np.cumsum(who == 1) % 2 == 1
        # between two edges heights are linear in x, so the slab's area is width times the height at its middle
        height = np.diff(y) * (hi - lo)
        for k, hits in enumerate((in_a & in_b, in_a & ~in_b, in_b & ~in_a)):
            out[k] += height[hits[:-1]].sum()
    return tuple(out.tolist())


def simplify_ring(r: np.ndarray, tolerance: float) -> np.ndarray:
    """A ring without the corners that lie within ``tolerance`` of the line between those kept; at least a triangle."""
    if len(r) <= 4:
        return r
    keep = np.zeros(len(r), bool)
    far = int(np.argmax(((r - r[0]) ** 2).sum(1)))
    keep[[0, far, len(r) - 1]] = True
    todo = [(0, far), (far, len(r) - 1)]
    while todo:
        s, e = todo.pop()
        if e - s < 2:
            continue
        p, q, m = r[s], r[e], r[s + 1 : e]
        d = q - p
        n = float(np.hypot(*d))
        dist = np.abs(d[0] * (m[:, 1] - p[1]) - d[1] * (m[:, 0] - p[0])) / n if n else np.hypot(*(m - p).T)
        k = int(dist.argmax())
        if dist[k] > tolerance:
            keep[s + 1 + k] = True
            todo += [(s, s + 1 + k), (s + 1 + k, e)]
    if keep.sum() < 4:
        rest = np.flatnonzero(~keep)
        keep[rest[np.argmax([abs(_signed(np.array([r[0], r[far], r[i], r[0]]))) for i in rest])]] = True
    return r[keep]


def text_of(rings: list[np.ndarray]) -> str | None:
    """Rings as a MULTIPOLYGON text: every ring that adds area with the holes inside it."""
    if not rings:
        return None
    signs = _depth_signs(rings)
    shells = [r for s, r in zip(signs, rings, strict=True) if s > 0]
    holes = [r for s, r in zip(signs, rings, strict=True) if s < 0]
    ring = lambda r: "(" + ", ".join(f"{x!r} {y!r}" for x, y in r.tolist()) + ")"
    parts = []
    for s in shells:
        lo, hi = s.min(0), s.max(0)
        mine = [h for h in holes if (h.min(0) >= lo).all() and (h.max(0) <= hi).all()]
        holes = [h for h in holes if not any(h is m for m in mine)]
        parts.append("(" + ", ".join(map(ring, [s, *mine])) + ")")
    return "MULTIPOLYGON (" + ", ".join(parts) + ")"


def _map_regions(regions: DataFrame, keys: list[str], geom: str, fields: str, f) -> DataFrame:
    rows = regions.filter(F.col(geom).isNotNull()).select(*keys, F.col(geom).alias("__geom")).distinct()
    names = [c.strip().split()[0] for c in fields.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(*key, *row) for *key, wkt in pdf.itertuples(index=False, name=None) for row in f(rings_of(wkt))]
            yield pd.DataFrame(out, columns=[*keys, *names])

    schema = ", ".join(f"`{k}` {regions.schema[k].dataType.simpleString()}" for k in keys) + ", " + fields
    # spread by key, so that a few large texts aren't one task's
    return rows.repartition(*keys).mapInPandas(run, schema)


def measures(regions: DataFrame, keys: list[str], geom: str = "geom") -> DataFrame:
    """(keys..., n_rings, area_mercator, area_sphere, cx, cy, xmin, ymin, xmax, ymax) of every distinct readable region.

    Areas in square metres, in spherical Mercator and on the sphere; cx, cy is the centroid in degrees. Null and
    unreadable geometries are left out.
    """

    def one(rings):
        if rings:
            every = np.vstack(rings)
            yield (len(rings), area_of([to_mercator(r) for r in rings]), sphere_area_of(rings), *centroid_of(rings), *every.min(0).tolist(), *every.max(0).tolist())

    return _map_regions(regions, keys, geom, "n_rings long, area_mercator double, area_sphere double, cx double, cy double, xmin double, ymin double, xmax double, ymax double", one)


def clip_to_grid(regions: DataFrame, keys: list[str], size: float, geom: str = "geom") -> DataFrame:
    """(keys..., ix, iy, area, share): area in square degrees of each region in each cell of ``size`` degrees it touches,
    and its share of the cell. Cells in which it has no area are left out."""

    def cells(rings):
        if not rings:
            return
        every = np.vstack(rings)
        lo, hi = np.floor(every.min(0) / size).astype(int), np.floor(every.max(0) / size).astype(int)
        signs = _depth_signs(rings)
        for ix in range(lo[0], hi[0] + 1):
            for iy in range(lo[1], hi[1] + 1):
                box = (ix * size, iy * size, (ix + 1) * size, (iy + 1) * size)
                got = [(s, clip_ring(r, box)) for s, r in zip(signs, rings, strict=True)]
                a = sum(s * abs(_signed(r)) for s, r in got if len(r) > 3)
                if a > 0:
                    yield ix, iy, a, a / (size * size)

    return _map_regions(regions, keys, geom, "ix long, iy long, area double, share double", cells)


def simplified(regions: DataFrame, keys: list[str], tolerance: float = 0.001, geom: str = "geom", more_than: int = 0) -> DataFrame:
    """(keys..., n_before, n_after, geom): regions with fewer corners, if there are more than ``more_than`` regions."""
    t = tolerance if regions.count() > more_than else None

    def one(rings):
        if rings:
            out = rings if t is None else [simplify_ring(r, t) for r in rings]
            yield sum(map(len, rings)), sum(map(len, out)), text_of(out)

    return _map_regions(regions, keys, geom, "n_before long, n_after long, geom string", one)


def overlaps(regions: DataFrame, keys: list[str], geom: str = "geom", size: float = 0.02) -> DataFrame:
    """(keys_a..., keys_b..., both, a_only, b_only) in square degrees of every two regions that share area.

    Candidates are regions whose boxes share a cell of ``size`` degrees; a pair is compared once.
    """
    boxes = measures(regions, keys, geom).select(*keys, "xmin", "ymin", "xmax", "ymax")
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size).cast("long"), F.floor(F.col(b) / size).cast("long")))
    cells = boxes.withColumn("ix", span("xmin", "xmax")).withColumn("iy", span("ymin", "ymax"))
    side = lambda s: cells.select("ix", "iy", F.struct(*keys).alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("xmin", "ymin", "xmax", "ymax")))
    near = side("a").join(side("b"), ["ix", "iy"]).filter("a < b AND xmin_a <= xmax_b AND xmin_b <= xmax_a AND ymin_a <= ymax_b AND ymin_b <= ymax_a").select("a", "b").distinct()
    text = regions.filter(F.col(geom).isNotNull()).groupBy(F.struct(*keys).alias("k")).agg(F.min(geom).alias("g"))
    pairs = near.join(text.select(F.col("k").alias("a"), F.col("g").alias("ga")), "a").join(text.select(F.col("k").alias("b"), F.col("g").alias("gb")), "b")
    flat = pairs.select(*(F.col(f"{s}.{k}").alias(f"{k}_{s}") for s in "ab" for k in keys), "ga", "gb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [overlay_areas(rings_of(x), rings_of(y)) for x, y in zip(pdf["ga"], pdf["gb"], strict=True)]
            out = pdf.drop(columns=["ga", "gb"])
            out[["both", "a_only", "b_only"]] = np.array(got).reshape(-1, 3)
            yield out[out["both"] > 0]

    schema = ", ".join(f"`{k}_{s}` {regions.schema[k].dataType.simpleString()}" for s in "ab" for k in keys) + ", both double, a_only double, b_only double"
    return flat.mapInPandas(run, schema)


def with_regions(points: DataFrame, regions: DataFrame, point_key: str, region_keys: list[str], attributes: list[str]) -> DataFrame:
    """Every point with the attributes of each region that contains it; points in none come out once, with nulls.

    ``attributes`` may name region columns beside the keys; of rows of one key the smallest values are taken.
    """
    inside = in_regions(points, regions, point_key, region_keys)
    extra = [a for a in attributes if a not in region_keys]
    facts = regions.groupBy(*region_keys).agg(*(F.min(a).alias(a) for a in extra)) if extra else regions.select(*region_keys).distinct()
    found = inside.join(facts, region_keys).select(point_key, *attributes)
    return points.join(found, point_key, "left")


def square_grid(xmin: float, ymin: float, xmax: float, ymax: float, size: float, spark) -> DataFrame:
    """(cell_id, ix, iy, x, y): squares of ``size`` over an extent from its lower left, numbered row by row; x, y are centres."""
    nx, ny = max(1, math.ceil((xmax - xmin) / size)), max(1, math.ceil((ymax - ymin) / size))
    t = spark.range(nx * ny).select((F.col("id") + 1).alias("cell_id"), (F.col("id") % nx).alias("ix"), F.expr(f"id div {nx}").alias("iy"))
    return t.withColumns({"x": F.lit(xmin) + (F.col("ix") + 0.5) * size, "y": F.lit(ymin) + (F.col("iy") + 0.5) * size})


def map_features(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points of interest, land use) from map objects (kind, osm_id, tags, is_closed, geom).

    Nodes with a class tag are points. Closed ways and relations with a landuse tag are land use and nothing else; with a
    class tag they are points. Of several class tags the first in the list of classes counts. Other objects are dropped.
    """
    first: Column = F
    for c in POI_CLASSES:
        first = first.when(F.element_at("tags", c).isNotNull(), F.struct(F.lit(c).alias("class"), F.element_at("tags", c).alias("type")))
    tag = lambda k: F.element_at("tags", k)
    t = objects.withColumns({"c": first, "area": (F.col("kind") == "relation") | ((F.col("kind") == "way") & F.coalesce("is_closed", F.lit(False)))})
    land = F.col("area") & tag("landuse").isNotNull()
    kind = F.upper(F.substring("kind", 1, 1)).alias("osm_type")
    poi = t.filter(~land & F.col("c").isNotNull() & (F.col("area") | (F.col("kind") == "node")))
    return (
        poi.select("osm_id", kind, "c.class", "c.type", tag("name").alias("name"), tag("addr:housenumber").alias("housenumber"), tag("addr:street").alias("street"), tag("addr:city").alias("city"), tag("addr:postcode").alias("postcode"), "geom"),
        t.filter(land).select("osm_id", kind, F.lit("landuse").alias("class"), tag("landuse").alias("type"), tag("name").alias("name"), tag("addr:city").alias("city"), "geom"),
    )
