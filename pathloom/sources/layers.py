"""Vector layers: GeoPackage (SQLite) and shapefiles, read with the standard library, as rows with well-known text.

Both formats are one file a layer on one machine; a folder of files is read one file a task. Geometry comes as text with
longitude first; rings keep their order.
"""

from __future__ import annotations

import glob
import os
import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_NAMES = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON"}


def wkb_text(b: bytes, at: int = 0) -> tuple[str, int]:
    """(well-known text, end) of a well-known binary; heights and measures are dropped."""
    order = "<" if b[at] == 1 else ">"
    (kind,) = struct.unpack_from(order + "I", b, at + 1)
    at += 5
    if kind & 0x20000000:
        at += 4
    dims = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000) + {0: 0, 1: 1, 2: 1, 3: 2}[(kind & 0xFFFF) // 1000]
    kind = (kind & 0xFFFF) % 1000

    def point(p: int) -> str:
        x, y = struct.unpack_from(order + "2d", b, p)
        return f"{x!r} {y!r}"

    def line(p: int) -> tuple[str, int]:
        (n,) = struct.unpack_from(order + "I", b, p)
        return "(" + ", ".join(point(p + 4 + i * 8 * dims) for i in range(n)) + ")", p + 4 + n * 8 * dims

    if kind == 1:
        return f"POINT ({point(at)})", at + 8 * dims
    if kind == 2:
        text, at = line(at)
        return f"LINESTRING {text}", at
    if kind not in _NAMES:
        raise ValueError(f"geometry type {kind}")
    (n,) = struct.unpack_from(order + "I", b, at)
    at += 4
    parts = []
    for _ in range(n):
        if kind == 3:
            text, at = line(at)
        else:
            text, at = wkb_text(b, at)
            text = text.split(" ", 1)[1]
        parts.append(text)
    return f"{_NAMES[kind]} ({', '.join(parts)})" if parts else f"{_NAMES[kind]} EMPTY", at


def geopackage_text(blob: bytes | None) -> str | None:
    """Well-known text of a GeoPackage geometry (header, envelope, binary); null and empty ones are null."""
    if not blob or blob[:2] != b"GP":
        return None
    flags = blob[3]
    if flags & 0x10:
        return None
    return wkb_text(bytes(blob), 8 + (0, 32, 48, 48, 64)[(flags >> 1) & 7])[0]


def geopackage_rows(path: str, layer: str | None = None) -> pd.DataFrame:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        found = con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name").fetchall()
        names = dict(found)
        if layer is None:
            layer = found[0][0]
        if layer not in names:
            raise ValueError(f"no layer {layer}; there are {', '.join(names)}")
        quoted = layer.replace('"', '""')
        pdf = pd.read_sql_query(f'SELECT * FROM "{quoted}"', con)
    geom = names[layer]
    pdf["geometry"] = [geopackage_text(g) for g in pdf[geom]]
    return pdf if geom == "geometry" else pdf.drop(columns=[geom])


def _dbf(path: str) -> Iterator[dict]:
    with open(path, "rb") as f:
        head = f.read(32)
        n, size, width = struct.unpack_from("<IHH", head, 4)
        fields = []
        while True:
            d = f.read(32)
            if d[:1] == b"\r" or len(d) < 32:
                break
            fields.append((d[:11].split(b"\0")[0].decode("ascii"), chr(d[11]), d[16], d[17]))
        f.seek(size)
        for _ in range(n):
            row, at, out = f.read(width), 1, {}
            for name, kind, length, decimals in fields:
                raw = row[at : at + length].decode("utf-8", "replace").strip()
                at += length
                if kind in "NF":
                    try:
                        out[name] = float(raw) if decimals or kind == "F" else int(raw)
                    except ValueError:
                        out[name] = None
                else:
                    out[name] = raw or None
            yield out


def shapefile_rows(path: str) -> pd.DataFrame:
    """Rows of a shapefile of points or polygons (with its .dbf beside it)."""
    geoms: list[str | None] = []
    with open(path, "rb") as f:
        f.seek(100)
        while len(head := f.read(8)) == 8:
            (length,) = struct.unpack(">I", head[4:])
            body = f.read(2 * length)
            (kind,) = struct.unpack_from("<I", body)
            if kind in (1, 11, 21):
                geoms.append("POINT ({!r} {!r})".format(*struct.unpack_from("<2d", body, 4)))
            elif kind in (5, 15, 25):
                parts, points = struct.unpack_from("<2I", body, 36)
                starts = [*struct.unpack_from(f"<{parts}I", body, 44), points]
                xy = struct.unpack_from(f"<{2 * points}d", body, 44 + 4 * parts)
                rings = ["(" + ", ".join(f"{xy[2 * i]!r} {xy[2 * i + 1]!r}" for i in range(s, e)) + ")" for s, e in zip(starts[:-1], starts[1:], strict=True)]
                geoms.append(f"POLYGON ({', '.join(rings)})")
            elif kind == 0:
                geoms.append(None)
            else:
                raise ValueError(f"shape type {kind}")
    pdf = pd.DataFrame(list(_dbf(path[:-4] + ".dbf")))
    pdf["geometry"] = geoms
    return pdf


def read_layer(spark: SparkSession, path: str, schema: str, layer: str | None = None) -> DataFrame:
    """Rows of all layers that match a path pattern in a shared folder, one file a task: columns of ``schema`` and geometry.

    Columns that a file lacks are null. ``path`` must be readable on executors.
    """
    files = sorted(glob.glob(path)) or [path]
    names = [c.strip().split()[0] for c in schema.split(",")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                pdf = geopackage_rows(p, layer) if os.path.splitext(p)[1].lower() == ".gpkg" else shapefile_rows(p)
                yield pdf.reindex(columns=[*names, "geometry"]).astype(object).where(lambda x: x.notna(), None)

    return spark.createDataFrame([(p,) for p in files], "path string").repartition(len(files)).mapInPandas(read, f"{schema}, geometry string")


def write_geopackage(pdf: pd.DataFrame, path: str, layer: str, geom: str = "geometry") -> None:
    """A small result as a GeoPackage of points: rows on the driver, for exchange with map programs."""
    if os.path.exists(path):
        os.remove(path)
    rest = [c for c in pdf.columns if c != geom]
    with sqlite3.connect(path) as con:
        con.execute("PRAGMA application_id = 1196444487")
        con.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, srs_id INTEGER)")
        con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER)")
        con.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, 4326)", (layer, layer))
        con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?, 'POINT', 4326, 0, 0)", (layer, geom))
        cols = ", ".join(f'"{c}"' for c in [*rest, geom])
        con.execute(f'CREATE TABLE "{layer}" ({cols})')
        blob = [struct.pack("<2sBBi", b"GP", 0, 1, 4326) + struct.pack("<BI2d", 1, 1, *map(float, g[g.index("(") + 1 : -1].split())) if isinstance(g, str) else None for g in pdf[geom]]
        con.executemany(f'INSERT INTO "{layer}" VALUES ({", ".join("?" * (len(rest) + 1))})', [(*r, b) for r, b in zip(pdf[rest].itertuples(index=False, name=None), blob, strict=True)])


def write_shapefile(rows: list[tuple[dict, list[list[tuple[float, float]]]]], path: str) -> None:
    """A small result as a shapefile of polygons: (attributes, rings) on the driver. Attributes become text of 40 bytes."""
    boxes, bodies = [], []
    for _, rings in rows:
        points = [p for r in rings for p in r]
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        boxes.append((min(xs), min(ys), max(xs), max(ys)))
        starts, at = [], 0
        for r in rings:
            starts.append(at)
            at += len(r)
        bodies.append(struct.pack("<I4d2I", 5, *boxes[-1], len(rings), len(points)) + struct.pack(f"<{len(starts)}I", *starts) + struct.pack(f"<{2 * len(points)}d", *(c for p in points for c in p)))
    every = tuple(f(b[i] for b in boxes) for i, f in enumerate((min, min, max, max))) if boxes else (0.0,) * 4
    size = 50 + sum(4 + len(b) // 2 for b in bodies)
    with open(path, "wb") as f:
        f.write(struct.pack(">7I", 9994, 0, 0, 0, 0, 0, size) + struct.pack("<2I8d", 1000, 5, *every, 0, 0, 0, 0))
        for i, b in enumerate(bodies, 1):
            f.write(struct.pack(">2I", i, len(b) // 2) + b)
    names = list(rows[0][0]) if rows else []
    with open(path[:-4] + ".dbf", "wb") as f:
        f.write(struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 33 + 32 * len(names), 1 + 40 * len(names)))
        for n in names:
            f.write(struct.pack("<11sc4x2B14x", n.encode()[:10], b"C", 40, 0))
        f.write(b"\r")
        for attributes, _ in rows:
            f.write(b" " + b"".join(str(attributes[n]).encode()[:40].ljust(40) for n in names))
