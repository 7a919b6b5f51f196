"""Sessions, stays and sliding counts of a stream of fixes.

The batch operators hold for whole tables; these give the same rows for what has passed the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geo import np_haversine_m


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of a folder (or one file) as a stream, with the schema they have now."""
    schema = spark.read.parquet(path).schema
    # as a pattern, since a stream takes a single file for a base folder
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_end(stream: DataFrame, folder: str, mode: str) -> str:
    """Runs a stream over all that is there and stops; the folder of its result as Parquet.

    ``complete`` keeps the last batch's table, ``append`` all batches' rows. Batches are written once whatever is tried
    again, as each has its own folder.
    """
    out = f"{folder}/out"
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")

    def write(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else i}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return out


def session_counts(fixes: DataFrame, gap: str = "30 minutes", late: str = "1 day", time: str = "ts") -> DataFrame:
    """(subid, start, end, n_fixes) of sessions parted by ``gap``; fixes later than ``late`` are dropped."""
    t = fixes.withWatermark(time, late).groupBy("subid", F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n_fixes"), F.min(time).alias("start"), F.max(time).alias("end"))
    return t.select("subid", "start", "end", "n_fixes")


def sliding_counts(fixes: DataFrame, length: str = "7 days", step: str = "1 day", late: str = "1 day", time: str = "ts") -> DataFrame:
    """(subid, start, end, n_fixes) of sliding windows."""
    return fixes.withWatermark(time, late).groupBy("subid", F.window(time, length, step).alias("w")).agg(F.count("*").alias("n_fixes")).select("subid", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_fixes")


def stays(fixes: DataFrame, dist_m: float = 50.0, gap_min: float = 60.0, time_min: float = 10.0, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """(subid, start_us, end_us, n_points, lat, lon) of stays, as soon as a later fix or the watermark closes them.

    Only the open stay's sums are kept per subject, so a position is the mean of a stay's fixes. Fixes of a batch are put
    in order of time; one that is older than the open stay's end is dropped.
    """
    schema = "subid long, start_us long, end_us long, n_points long, lat double, lon double"
    state_schema = "start_us long, end_us long, n long, lat_sum double, lon_sum double, lat double, lon double"

    def row(key, s):
        return (key[0], s[0], s[1], s[2], s[3] / s[2], s[4] / s[2])

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed = []
        s = state.get if state.exists else None
        if state.hasTimedOut:
            if s is not None and s[1] - s[0] >= time_min * 6e7:
                closed.append(row(key, s))
            state.remove()
        else:
            p = pd.concat(list(batches)).sort_values("us", kind="stable")
            for us, lat, lon in zip(p["us"].tolist(), p["lat"].tolist(), p["lon"].tolist(), strict=True):
                if s is not None and us < s[1]:
                    continue
                if s is not None and us - s[1] <= gap_min * 6e7 and float(np_haversine_m(s[6], s[5], lon, lat)) <= dist_m:
                    s = (s[0], us, s[2] + 1, s[3] + lat, s[4] + lon, lat, lon)
                else:
                    if s is not None and s[1] - s[0] >= time_min * 6e7:
                        closed.append(row(key, s))
                    s = (us, us, 1, lat, lon, lat, lon)
            state.update(s)
            state.setTimeoutTimestamp(max(s[1] // 1000 + int(gap_min * 60_000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(closed, columns=["subid", "start_us", "end_us", "n_points", "lat", "lon"]).astype({"start_us": np.int64, "end_us": np.int64, "n_points": np.int64})

    rows = fixes.filter("subid IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").withWatermark(time, late).select(F.col("subid").cast("long").alias("subid"), time, F.unix_micros(time).alias("us"), "lat", "lon")
    return rows.groupBy("subid").applyInPandasWithState(step, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)
