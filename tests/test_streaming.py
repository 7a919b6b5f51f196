"""Streams over several files give the rows of the batch operators; late fixes and open stays."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from pathloom.functions.geo import EARTH_M
from pathloom.operators.sessions import sessions
from pathloom.streaming import activity

STEP = 57.29577951308232 / EARTH_M


def write(spark, folder, parts):
    for i, rows in enumerate(parts):
        df = spark.createDataFrame([(k, s, 43.0 + m * STEP, -89.0, t) for k, s, m, t in rows], "processed_id long, subid int, lat double, lon double, sec long")
        df.selectExpr("processed_id", "subid", "lat", "lon", "cast(timestamp_seconds(sec + 86400) AS timestamp_ntz) AS time").coalesce(1).write.mode("append").parquet(f"{folder}/part={i}")
        for f in glob.glob(f"{folder}/part={i}/*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))  # a stream takes files by age
    return f"{folder}/part=*"


@pytest.fixture
def fixes(spark, tmp_path):
    m = 60
    parts = [
        [(1, 1, 0, 0), (2, 1, 5, 6 * m), (3, 1, 3, 12 * m), (4, 2, 0, 0)],
        [(5, 1, 90, 14 * m), (6, 1, 92, 44 * m), (7, 2, 0, 90 * m)],
        [(8, 1, 500, 200 * m), (9, 2, 0, 91 * m), (10, 3, 0, 500 * m)],
    ]
    return write(spark, str(tmp_path / "fixes"), parts)


def stream(spark, path):
    schema = spark.read.parquet(path).select("processed_id", "subid", "lat", "lon", "time").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).select("processed_id", "subid", "lat", "lon", F.col("time").cast("timestamp").alias("ts"))


def test_sessions(spark, fixes, tmp_path):
    got = spark.read.parquet(activity.run_to_end(activity.session_counts(stream(spark, fixes), "1800.000001 seconds"), str(tmp_path / "s"), "complete"))
    batch = sessions(spark.read.parquet(fixes))
    key = lambda rows, n: sorted((r["subid"], r[n]) for r in rows.collect())
    assert key(got, "n_fixes") == key(batch, "n_events") and batch.count() == 5


def test_sliding_counts(spark, fixes, tmp_path):
    got = spark.read.parquet(activity.run_to_end(activity.sliding_counts(stream(spark, fixes), "2 hours", "1 hour"), str(tmp_path / "s"), "complete"))
    assert got.agg(F.sum("n_fixes")).first()[0] == 20  # every fix is in two windows


def test_stays_close_with_a_later_fix_or_the_watermark(spark, fixes, tmp_path):
    got = spark.read.parquet(activity.run_to_end(activity.stays(stream(spark, fixes), late="10 minutes"), str(tmp_path / "s"), "append"))
    rows = sorted((r["subid"], r["start_us"] // 60_000_000 - 1440, r["end_us"] // 60_000_000 - 1440, r["n_points"]) for r in got.collect())
    assert rows == [(1, 0, 12, 3), (1, 14, 44, 2)]
