"""The data part of maps: filtered, coloured, sampled rows, popup texts and bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import points_where, sample_rows


def _line(name: str, value: Column) -> Column:
    """A popup line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"<strong>{name}:</strong> "), value.cast("string"), F.lit("<br/>")), F.lit(""))


def subject_points(fixes: DataFrame, subid: int, movement: str | None = None, bbox=None) -> DataFrame:
    """A subject's points with a colour by state; ValueError if there are none."""
    t = points_where(fixes, subid, movement, bbox)
    if not t.limit(1).count():
        raise ValueError(f"no points of subject {subid}")
    state = F.col("movement_state")
    return t.withColumn("colour", F.when(state == "stationary", "blue").when(state == "transition", "orange").otherwise("grey"))


def centre(points: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    return points.groupBy(*by).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n"))


def bounds(points: DataFrame, by: list[str] = [], pad: float = 0.01) -> DataFrame:  # noqa: B006
    """Extent of points, wider by ``pad`` degrees on every side."""
    return points.groupBy(*by).agg((F.min("lon") - pad).alias("xmin"), (F.min("lat") - pad).alias("ymin"), (F.max("lon") + pad).alias("xmax"), (F.max("lat") + pad).alias("ymax"))


def shown_objects(objects: DataFrame, key: str, classes: list[str] | None = None, types: list[str] | None = None, most: int = 10_000) -> DataFrame:
    """Objects of classes and types; of more than ``most`` a fixed sample, as a map shows no more."""
    t = objects
    t = t if classes is None else t.filter(F.col("class").isin(classes))
    t = t if types is None else t.filter(F.col("type").isin(types))
    return sample_rows(t, most, key) if t.count() > most else t


def fix_popup(show_speed: bool = False) -> Column:
    speed = _line("Speed", F.concat(F.round("speed_mph", 1).cast("string"), F.lit(" mph"))) if show_speed else F.lit("")
    dwell = F.when(F.col("dwell_time_seconds") > 0, _line("Dwell", F.concat(F.round(F.col("dwell_time_seconds") / 60, 1).cast("string"), F.lit(" min")))).otherwise("")
    return F.concat(F.lit("<strong>GPS point</strong><br/>"), _line("Time", F.date_format("time", "yyyy-MM-dd HH:mm:ss")), _line("Movement", F.coalesce("movement_state", F.lit("unknown"))), speed, dwell, F.lit("<strong>Location:</strong> "), F.format_string("%.6f, %.6f", "lat", "lon"))


def titled(c: str) -> Column:
    return F.initcap(F.regexp_replace(c, "_", " "))


def object_popup(category: Column | None = None) -> Column:
    head = F.coalesce(F.concat(F.lit("<strong>"), category, F.lit("</strong><br/>")), F.lit("")) if category is not None else F.lit("")
    return F.concat(head, F.lit("<strong>"), titled("class"), F.lit(" - "), titled("type"), F.lit("</strong><br/>"), _line("Address", F.nullif(address("street", "city"), F.lit(""))), _line("ID", F.col("osm_id")))


def region_popup() -> Column:
    area = F.when(~F.isnan("area_sqkm"), F.col("area_sqkm"))
    return F.concat(F.lit("<strong>"), titled("class"), F.lit(" - "), titled("type"), F.lit("</strong><br/>"), _line("Area", F.concat(F.format_number(F.round(area, 3), 3), F.lit(" km²"))), _line("ID", F.col("osm_id")))


def address(*parts: str) -> Column:
    """Non-empty parts joined by commas."""
    return F.concat_ws(", ", *(F.nullif(p, F.lit("")) for p in parts))
