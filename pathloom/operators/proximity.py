"""Points near points and points in regions, by cell equi-joins.

Points near points: every object is written to the cells that its circle can touch, fixes look up their own cell, and
the great-circle distance decides. Points in regions: an adaptive coverage splits each region into cells of several
sizes. Cells wholly inside accept at once; only in boundary cells is the exact containment test made, and there only
against the edges that can matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, haversine_m, mercator_distance
from ..session import lookup_join, materialize

#: Coverage cells have 2**-level degrees; regions are covered by cells as coarse as they allow, down to this level.
FINEST = 10
#: and at most so many levels below the region's own size, so a region has a bounded number of cells along its rim.
DEPTH = 6
#: Beyond this latitude points share one column of cells, and its number.
POLAR, POLE = 89.0, -(1 << 40)
#: Cells are sent to all tasks only up to this measured size; beyond it probes of a cell are spread over SALT parts.
BROADCAST_BYTES, SALT = 128 << 20, 16


def rings_of(wkt: str | None) -> list[np.ndarray]:
    """Rings of a POLYGON or MULTIPOLYGON text, longitude first, with or without an SRID prefix, as (n, 2) arrays.

    Anything else, or a text that can't be read, has no rings. With even-odd counting over all rings their direction and
    grouping don't matter, and holes come out right.
    """
    if not wkt:
        return []
    body = wkt.split(";", 1)[-1].strip()
    if not re.match(r"(?i)(multi)?polygon\b", body):
        return []
    rings = []
    for ring in re.findall(r"\(([^()]+)\)", body):
        xy = [p.split()[:2] for p in ring.split(",") if p.strip()]
        try:
            a = np.array(xy, float)
        except ValueError:
            return []
        if len(a) >= 3:
            rings.append(a if (a[0] == a[-1]).all() else np.vstack([a, a[:1]]))
    return rings


def _edges(rings: list[np.ndarray]) -> np.ndarray:
    """(n, 4) edges x1, y1, x2, y2 without the vertical ones, which an upward ray never crosses."""
    e = np.vstack([np.hstack([r[:-1], r[1:]]) for r in rings])
    return e[e[:, 0] != e[:, 2]]


def _inside(x: float, y: float, e: np.ndarray) -> bool:
    """Even-odd test by an upward ray."""
    hit = (e[:, 0] > x) != (e[:, 2] > x)
    e = e[hit]
    return bool(np.count_nonzero(e[:, 1] + (x - e[:, 0]) / (e[:, 2] - e[:, 0]) * (e[:, 3] - e[:, 1]) > y) & 1)


def _touches(box: tuple[float, float, float, float], segs: np.ndarray) -> np.ndarray:
    """Which segments can touch a box (exact up to a clip of its diagonal; never misses one)."""
    x0, y0, x1, y1 = box
    near = (np.maximum(segs[:, 0], segs[:, 2]) >= x0) & (np.minimum(segs[:, 0], segs[:, 2]) <= x1) & (np.maximum(segs[:, 1], segs[:, 3]) >= y0) & (np.minimum(segs[:, 1], segs[:, 3]) <= y1)
    s = segs[near]
    side = [(s[:, 2] - s[:, 0]) * (y - s[:, 1]) - (s[:, 3] - s[:, 1]) * (x - s[:, 0]) for x in (x0, x1) for y in (y0, y1)]
    cross = (np.min(side, axis=0) <= 0) & (np.max(side, axis=0) >= 0)
    near[near] = cross
    return near


def coverage(rings: list[np.ndarray], finest: int = FINEST) -> Iterator[tuple[int, int, int, list[float] | None]]:
    """(level, ix, iy, edges) of cells that cover a region; edges is None inside, else those an exact test needs."""
    if not rings:
        return
    every, segs = _edges(rings), np.vstack([np.hstack([r[:-1], r[1:]]) for r in rings])
    lo, hi = np.min([r.min(0) for r in rings], axis=0), np.max([r.max(0) for r in rings], axis=0)
    # from the level at which the region's box is a cell or two wide
    first = min(finest, math.floor(-math.log2(max(float((hi - lo).max()), 1e-9))))
    finest = min(finest, first + DEPTH)
    size = 2.0**-first
    todo = [(first, ix, iy, segs) for ix in range(math.floor(lo[0] / size), math.floor(hi[0] / size) + 1) for iy in range(math.floor(lo[1] / size), math.floor(hi[1] / size) + 1)]
    while todo:
        level, ix, iy, s = todo.pop()
        size = 2.0**-level
        box = (ix * size, iy * size, (ix + 1) * size, (iy + 1) * size)
        s = s[_touches(box, s)]
        if not len(s):
            if _inside((box[0] + box[2]) / 2, (box[1] + box[3]) / 2, every):
                yield level, ix, iy, None
        elif level < finest:
            todo += [(level + 1, 2 * ix + i, 2 * iy + j, s) for i in (0, 1) for j in (0, 1)]
        else:
            # an upward ray from a point of the cell crosses only edges over the cell's width that reach above its foot
            need = every[(np.maximum(every[:, 0], every[:, 2]) >= box[0]) & (np.minimum(every[:, 0], every[:, 2]) <= box[2]) & (np.maximum(every[:, 1], every[:, 3]) >= box[1])]
            if len(need):  # else no ray meets the region, and the cell lies outside but for its rim
                yield level, ix, iy, need.ravel().tolist()


def region_cells(regions: DataFrame, keys: list[str], geom: str = "geom", finest: int = FINEST) -> DataFrame:
    """Coverage cells of regions given as well-known text: (keys..., level, ix, iy, covers).

    ``covers`` holds for each text of a key that touches the cell its edges, or an empty array where the cell lies
    inside. Null, empty and unreadable texts cover nothing. Equal rows count once.
    """
    rows = regions.filter(F.col(geom).isNotNull()).select(*keys, F.col(geom).alias("__geom")).distinct()

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for *key, wkt in pdf.itertuples(index=False, name=None):
                cells = list(coverage(rings_of(wkt), finest))
                if cells:
                    out = pd.DataFrame(cells, columns=["level", "ix", "iy", "edges"])
                    out["edges"] = [e or [] for e in out["edges"]]
                    for k, v in zip(keys, key, strict=True):
                        out[k] = v
                    yield out[[*keys, "level", "ix", "iy", "edges"]]

    schema = ", ".join(f"`{k}` {regions.schema[k].dataType.simpleString()}" for k in keys) + ", level int, ix long, iy long, edges array<double>"
    # each region is a task's work of its own, however few bytes it has
    rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, *keys)
    return rows.mapInPandas(cover, schema).groupBy(*keys, "level", "ix", "iy").agg(F.collect_list("edges").alias("covers"))


def _probe_join(probes: DataFrame, cells: DataFrame, on: list[str], payload: Column) -> DataFrame:
    """Equi-join of probes with cells; the cells are broadcast only if their size, measured first, is small.

    Otherwise both sides are shuffled, with the probes of a cell spread over ``SALT`` parts and the cells repeated for
    each, so a cell with a third of all probes is no single task's. ``payload`` is the number of doubles in a cell's row.
    """
    n = cells.agg((F.count("*") * 100 + F.coalesce(F.sum(payload), F.lit(0)) * 8).alias("n")).first()["n"]
    if n <= BROADCAST_BYTES:
        return probes.join(F.broadcast(cells), on)
    salted = probes.withColumn("__salt", F.pmod(F.xxhash64("__p"), F.lit(SALT)).cast("int"))
    return salted.join(cells.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), [*on, "__salt"]).drop("__salt")


def in_regions(points: DataFrame, regions: DataFrame, point_key: str, region_keys: list[str], lon: str = "lon", lat: str = "lat", geom: str = "geom", finest: int = FINEST) -> DataFrame:
    """(point_key, region_keys...) for each point in each region that contains it; holes don't contain.

    A region key with several texts contains what any of them contains, and comes out once a point. Points with a null
    position or key match nothing; null or unreadable geometries contain nothing; empty tables give no rows.
    """
    cells = materialize(region_cells(regions, region_keys, geom, finest))
    levels = [r["level"] for r in cells.select("level").distinct().orderBy("level").collect()]  # at most `finest` and a few
    p = points.filter(F.col(point_key).isNotNull() & F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.col(point_key).alias("__p"), F.col(lon).alias("__x"), F.col(lat).alias("__y"))
    level = F.explode(F.array(*(F.lit(k) for k in levels)).cast("array<int>"))
    scale = F.pow(F.lit(2.0), F.col("level"))
    # a probe for every level that any region is covered at
    probes = p.withColumn("level", level).select("__p", "__x", "__y", "level", F.floor(F.col("__x") * scale).cast("long").alias("ix"), F.floor(F.col("__y") * scale).cast("long").alias("iy"))
    found = _probe_join(probes, cells, ["level", "ix", "iy"], F.aggregate("covers", F.lit(0), lambda acc, x: acc + F.size(x)))

    def above(edges, k):
        at = lambda j: F.element_at(edges, k * 4 + j)
        x, y = F.col("__x"), F.col("__y")
        straddles = (at(1) > x) != (at(3) > x)
        return F.when(straddles, F.when(at(2) + (x - at(1)) / (at(3) - at(1)) * (at(4) - at(2)) > y, 1).otherwise(0)).otherwise(0)

    def holds(edges):
        count = F.aggregate(F.sequence(F.lit(0), (F.size(edges) / 4 - 1).cast("int")), F.lit(0), lambda acc, k: acc + above(edges, k))
        return F.when(F.size(edges) == 0, F.lit(True)).otherwise(count % 2 == 1)

    hit = found.filter(F.exists("covers", holds))
    return hit.select(F.col("__p").alias(point_key), *region_keys)


def point_of(geom: str = "geom"):
    """(lon, lat) of a well-known text of a POINT, with or without SRID; null if it is none."""
    pattern = r"(?i)^\s*(?:SRID\s*=\s*\d+\s*;)?\s*POINT\s*\(\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)\s*\)\s*$"
    part = lambda k: F.nullif(F.regexp_extract(geom, pattern, k), F.lit("")).try_cast("double")
    return part(1), part(2)


def _circle_cells(objects: DataFrame, lon: str, lat: str, reach: float, size: float, ix: str, iy: str) -> DataFrame:
    """Objects written to all cells that the circle of ``reach`` degrees about them can touch, also over the 180th meridian
    and over the poles."""
    x, y = F.col(lon), F.col(lat)
    wide = F.least(F.lit(180.0), F.lit(reach) / F.cos(F.radians(F.least(F.abs(y) + reach, F.lit(POLAR)))))
    none = F.array().cast("array<bigint>")

    def columns(turn: float):
        lo, hi = F.greatest(x + turn - wide, F.lit(-180.0)), F.least(x + turn + wide, F.lit(180.0))
        return F.when(lo <= hi, F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))).otherwise(none)

    polar = F.when(F.abs(y) + reach >= POLAR, F.array(F.lit(POLE))).otherwise(none)
    across = F.array_distinct(F.concat(columns(0.0), columns(360.0), columns(-360.0), polar))
    return objects.withColumn(ix, F.explode(across)).withColumn(iy, F.explode(F.sequence(F.floor((y - reach) / size).cast("long"), F.floor((y + reach) / size).cast("long"))))


def _point_cell(lon: str, lat: str, size: float, ix: str, iy: str) -> list[Column]:
    return [F.when(F.abs(F.col(lat)) >= POLAR, F.lit(POLE)).otherwise(F.floor(F.col(lon) / size).cast("long")).alias(ix), F.floor(F.col(lat) / size).cast("long").alias(iy)]


def near_points(points: DataFrame, objects: DataFrame, point_key: str, object_keys: list[str], radius_m: float, lon: str = "lon", lat: str = "lat", object_lon: str = "lon", object_lat: str = "lat") -> DataFrame:
    """(point_key, object_keys...) for each object at most ``radius_m`` (great circle) from a point.

    An object key with several positions comes out once a point. Null positions or keys match nothing, empty tables
    give no rows. Objects are written to the cells that their circle can touch (cells are a little larger than the
    radius, so these are at most nine away from the poles); points keep one cell each.
    """
    size = math.degrees(radius_m / EARTH_M) * 1.5
    reach = math.degrees(radius_m / EARTH_M) * 1.000001
    o = objects.filter(F.col(object_lon).isNotNull() & F.col(object_lat).isNotNull()).select(*object_keys, F.col(object_lon).alias("__ox"), F.col(object_lat).alias("__oy")).distinct()
    cells = _circle_cells(o, "__ox", "__oy", reach, size, "ix", "iy").groupBy("ix", "iy", *object_keys).agg(F.collect_list(F.struct("__ox", "__oy")).alias("spots"))
    cells = materialize(cells)
    p = points.filter(F.col(point_key).isNotNull() & F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.col(point_key).alias("__p"), F.col(lon).alias("__x"), F.col(lat).alias("__y"), *_point_cell(lon, lat, size, "ix", "iy"))
    found = _probe_join(p, cells, ["ix", "iy"], 2 * F.size("spots"))
    hit = found.filter(F.exists("spots", lambda s: haversine_m(F.col("__x"), F.col("__y"), s["__ox"], s["__oy"]) <= radius_m))
    return hit.select(F.col("__p").alias(point_key), *object_keys)


def radius_join(points: DataFrame, objects: DataFrame, radius_m: float, by: list[str] = [], lon: str = "lon", lat: str = "lat", object_lon: str = "olon", object_lat: str = "olat", metric: str = "geodesic") -> DataFrame:  # noqa: B006
    """Every point with every object of equal ``by`` columns at most ``radius_m`` away: all columns of both, and dist_m.

    ``metric``: ``geodesic`` (great circle) or ``mercator`` (planar metres of spherical Mercator, larger than on the
    ground). Columns other than ``by`` must differ. Objects are written to the cells that their circle can touch; points
    keep one cell. Null positions or keys match nothing.
    """
    reach = math.degrees(radius_m / EARTH_M) * 1.000001
    size = reach * 1.5
    here = lambda df, x, y: df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    o = _circle_cells(here(objects, object_lon, object_lat), object_lon, object_lat, reach, size, "__ix", "__iy")
    p = here(points, lon, lat)
    p = p.select(*p.columns, *_point_cell(lon, lat, size, "__ix", "__iy"))
    dist = {"geodesic": haversine_m, "mercator": mercator_distance}[metric](lon, lat, object_lon, object_lat)
    found = lookup_join(p, o, [*by, "__ix", "__iy"], spread=lat, width=32 * (len(objects.columns) + 2))
    return found.withColumn("dist_m", dist).filter(F.col("dist_m") <= radius_m).drop("__ix", "__iy")


def nearest(points: DataFrame, objects: DataFrame, key: str, category: str, object_key: list[str], start_m: float = 1000.0, rank_by: str = "meters") -> DataFrame:
    """(key, category, object_key..., dist_m): each point's nearest object of every category that has one, however far.

    Rings: an object within a radius is certain to be the nearest once any was found there, so points search a radius and
    those without a hit go on with four times as much. ``rank_by="degrees"`` ranks by planar degrees and still reports
    metres. Ties go to the smallest object key. Points with a null position or key are left out.
    """
    todo = points.filter(F.col(key).isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(key, "lon", "lat")
    named = objects.filter(F.col(category).isNotNull() & F.col("olon").isNotNull() & F.col("olat").isNotNull()).select(category, *object_key, "olon", "olat")
    named = materialize(named)
    todo = materialize(todo.join(F.broadcast(named.select(category).distinct())))  # a category name a point each
    planar = F.sqrt(F.pow(F.col("lon") - F.col("olon"), F.lit(2.0)) + F.pow(F.col("lat") - F.col("olat"), F.lit(2.0)))
    out, radius = None, start_m
    while True:
        last = radius > 20_100_000
        if last:
            # what is left is more than half the globe from everything seen so far
            near = lookup_join(todo, named, [category], spread="lat", width=64).withColumn("dist_m", haversine_m("lon", "lat", "olon", "olat"))
        else:
            near = radius_join(todo, named, radius, by=[category])
        score = planar if rank_by == "degrees" else F.col("dist_m")
        if rank_by == "degrees" and not last:
            # within this many degrees everything lies in the circle, whatever its direction
            near = near.filter(score <= math.degrees(radius / EARTH_M))
        best = near.groupBy(key, category).agg(F.min(F.struct(score.alias("s"), *object_key, "dist_m")).alias("b")).select(key, category, *(f"b.{k}" for k in object_key), "b.dist_m")
        best = materialize(best)
        out = best if out is None else out.unionByName(best)
        todo = materialize(todo.join(best.select(key, category), [key, category], "left_anti"))
        if last or not todo.limit(1).count():
            return out
        radius *= 4


def radius_counts(points: DataFrame, objects: DataFrame, key: str, category: str, categories: list[str], radii_m: list[float], metric: str = "geodesic", prefix: str = "n_") -> DataFrame:
    """(key, n_<category>_<radius>...) numbers of objects within each radius; 0 where there are none.

    One join at the largest radius, conditional counts, and a left join back to all points. A null key is left out; a
    point with a null position has zeros.
    """
    near = radius_join(points.select(key, "lon", "lat"), objects.filter(F.col(category).isin(categories)), max(radii_m), metric=metric)
    counts = {f"{prefix}{c}_{r:g}": F.count_if((F.col(category) == c) & (F.col("dist_m") <= r)) for c in categories for r in radii_m}
    t = near.groupBy(key).agg(*(x.alias(n) for n, x in counts.items()))
    return points.filter(F.col(key).isNotNull()).select(key).join(t, key, "left").fillna(0, list(counts))


def visit_match(points: DataFrame, objects: DataFrame, key: str, object_key: list[str], columns: list[str], radius_m: float = 50.0, candidates: int = 5) -> DataFrame:
    """(key, columns..., dist_m): of a point's ``candidates`` nearest objects by degrees the first within ``radius_m``.

    An object within the radius is within a known number of degrees, so only objects that near are ranked: those
    farther by degrees come after all that could match. Points without a match are left out.
    """
    edge = math.degrees(radius_m / EARTH_M)
    # the widest degrees of the radius at the highest latitude there is
    top = points.agg(F.max(F.abs(F.col("lat")))).first()[0]
    if top is None:
        top = 0.0
    wide = edge / max(math.cos(math.radians(min(float(top) + edge, 89.0))), 1e-3)
    reach_m = math.radians(wide) * EARTH_M * 1.001
    near = radius_join(points.select(key, "lon", "lat"), objects.select(*object_key, *(c for c in columns if c not in object_key), "olon", "olat"), reach_m)
    planar = F.sqrt(F.pow(F.col("lon") - F.col("olon"), F.lit(2.0)) + F.pow(F.col("lat") - F.col("olat"), F.lit(2.0)))
    ranked = near.withColumn("__deg", planar).withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy("__deg", *object_key)))
    first = ranked.filter((F.col("__rank") <= candidates) & (F.col("dist_m") <= radius_m))
    return first.groupBy(key).agg(F.min(F.struct("__rank", *columns, "dist_m")).alias("b")).select(key, *(f"b.{c}" for c in columns), "b.dist_m")
