"""Collapsing ordered events: sessions parted by silence and runs of one state, in constant memory per slice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize
from .ordered import SLICE_ROWS, sliced

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def micros(column: str):
    """Microseconds since 1970 of a zoneless timestamp, free of the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast({column} AS timestamp_ntz))")


def from_micros(column: str):
    return F.expr(f"timestampadd(MICROSECOND, {column}, {EPOCH})")


def collapse(events: DataFrame, entity: str, us: str, event_id: str, *, silence_us: int, n_rows: int, state: str | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per longest run of successive events of an entity: (entity, [state], start_us, start_id, end_us, end_id, n).

    A run ends where the entity or the state changes or where more than ``silence_us`` pass between two events (exactly
    that long doesn't part them). Order is (entity, us, event_id). Rows with a null entity, time, id or state must be
    left out by the caller. The secondary sort is by range slices, so a heavy entity is spread over slices; each slice
    is scanned once, batch by batch, and only its open run is kept. Runs that touch a slice's ends (two a slice) are
    joined afterwards.
    """
    keys = [entity, *([state] if state else [])]
    fields = [*(T.StructField(k, events.schema[k].dataType) for k in keys), *(T.StructField(c, T.LongType()) for c in ("start_us", "start_id", "end_us", "end_id", "n")), T.StructField("at_start", T.BooleanType()), T.StructField("at_end", T.BooleanType()), T.StructField("slice", T.LongType())]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        held, opening = None, True  # the run still open; whether it is the slice's first
        for b in batches:
            if not b.num_rows:
                continue
            t, i = b.column(us).to_numpy(), b.column(event_id).to_numpy()
            ks = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.ones(len(t), bool)
            new[1:] = t[1:] - t[:-1] > silence_us
            for k in ks:
                new[1:] |= k[1:] != k[:-1]
            if held is not None:
                new[0] = t[0] - held["end_us"] > silence_us or any(k[0] != h for k, h in zip(ks, held["keys"], strict=True))
            s = np.flatnonzero(new)
            if held is not None and (not len(s) or s[0] > 0):  # rows that go on with the open run
                stop = int(s[0]) if len(s) else len(t)
                held |= {"end_us": int(t[stop - 1]), "end_id": int(i[stop - 1]), "n": held["n"] + stop}
            if not len(s):
                continue
            if held is not None:
                yield one(held, opening, False, at)
                opening = False
            e = np.r_[s[1:], len(t)] - 1
            if len(s) > 1:
                m = len(s) - 1
                first = np.zeros(m, bool)
                first[0] = opening
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([*(k[s[:-1]] for k in ks), t[s[:-1]], i[s[:-1]], t[e[:-1]], i[e[:-1]], (e - s + 1)[:-1], first, np.zeros(m, bool), np.full(m, at)], arrow, strict=True)], schema=arrow)
                opening = False
            held = {"keys": [k[s[-1]] for k in ks], "start_us": int(t[s[-1]]), "start_id": int(i[s[-1]]), "end_us": int(t[-1]), "end_id": int(i[-1]), "n": int(e[-1] - s[-1] + 1)}
        if held is not None:
            yield one(held, opening, True, at)

    def one(h: dict, first: bool, last: bool, at: int) -> pa.RecordBatch:
        row = [*h["keys"], h["start_us"], h["start_id"], h["end_us"], h["end_id"], h["n"], first, last, at]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow, strict=True)], schema=arrow)

    runs = materialize(sliced(events.select(*keys, us, event_id), [entity, us, event_id], n_rows, slice_rows).mapInArrow(scan, schema))
    inner = runs.filter("NOT at_start AND NOT at_end")
    # two rows a slice: chained where the last run of a slice goes on as the first of the next
    w = Window.partitionBy(entity).orderBy("start_us", "start_id", "slice")
    goes_on = F.col("at_start") & F.lag("at_end").over(w) & (F.lag("slice").over(w) != F.col("slice")) & (F.col("start_us") - F.lag("end_us").over(w) <= silence_us)
    if state:
        goes_on &= F.lag(state).over(w).eqNullSafe(F.col(state))
    open_runs = runs.filter("at_start OR at_end").withColumn("part", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("part").over(w))
    last = F.struct("end_us", "slice", "end_id")
    first = F.struct("start_us", "slice", "start_id")
    joined = open_runs.groupBy(entity, "run").agg(*([F.first(state).alias(state)] if state else []), F.min(first).alias("f"), F.max(last).alias("l"), F.sum("n").alias("n"))
    columns = [*keys, "start_us", "start_id", "end_us", "end_id", "n"]
    return inner.select(*columns).unionByName(joined.select(*keys, "f.start_us", "f.start_id", "l.end_us", "l.end_id", "n"))


def sessions(events: DataFrame, entity: str = "subid", time: str = "time", event_id: str = "processed_id", gap_minutes: float = 30, n_rows: int | None = None) -> DataFrame:
    """Sessions of activity parted by silences longer than ``gap_minutes``, also those of one event.

    Result: (entity, start_id, end_id, start_time, end_time, duration_s, n_events). Events with a null entity, time or
    id belong to no session. Equal times are ordered by id; repeated rows count each. Empty input gives no rows.
    """
    rows = events.filter(f"{entity} IS NOT NULL AND {time} IS NOT NULL AND {event_id} IS NOT NULL").select(F.col(entity).alias("entity"), micros(time).alias("us"), F.col(event_id).cast("long").alias("event_id"))
    s = collapse(rows, "entity", "us", "event_id", silence_us=int(gap_minutes * 60_000_000), n_rows=events.count() if n_rows is None else n_rows)
    return s.select(F.col("entity").alias(entity), "start_id", "end_id", from_micros("start_us").alias("start_time"), from_micros("end_us").alias("end_time"), ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"), F.col("n").alias("n_events"))
