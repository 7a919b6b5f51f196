"""Per-key results where a few keys hold most rows: dense accumulator arrays instead of a shuffle by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize

#: Blocks that keys fall into by hash, blocks merged at a step of the reduction, and keys a task holds before it hands them on.
BLOCKS, FAN_IN, HELD_KEYS = 4096, 32, 1_000_000

_FIELDS = {"keys": T.LongType(), "rows": T.LongType(), "first": T.LongType(), "last": T.LongType(), "total": T.DoubleType()}
_PARTS = T.StructType([T.StructField("block", T.LongType()), T.StructField("node", T.LongType()), *(T.StructField(c, T.ArrayType(t)) for c, t in _FIELDS.items())])
_NONE_FIRST, _NONE_LAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min

Block = dict[str, np.ndarray]


def _reduce(parts: list[Block]) -> Block:
    """Accumulators of several dictionaries as those of their union: keys are encoded, arrays added by code."""
    keys, code = np.unique(np.concatenate([p["keys"] for p in parts]), return_inverse=True)
    cat = lambda c: np.concatenate([p[c] for p in parts])
    first, last, rows = np.full(len(keys), _NONE_FIRST), np.full(len(keys), _NONE_LAST), np.zeros(len(keys), np.int64)
    np.minimum.at(first, code, cat("first"))
    np.maximum.at(last, code, cat("last"))
    np.add.at(rows, code, cat("rows"))
    return {"keys": keys, "rows": rows, "first": first, "last": last, "total": np.bincount(code, weights=cat("total"), minlength=len(keys))}


def _count(k: np.ndarray, u: np.ndarray, known: np.ndarray, a: np.ndarray) -> Block:
    """Accumulators of a batch of rows."""
    keys, code = np.unique(k, return_inverse=True)
    first, last = np.full(len(keys), _NONE_FIRST), np.full(len(keys), _NONE_LAST)
    np.minimum.at(first, code[known], u[known])
    np.maximum.at(last, code[known], u[known])
    return {"keys": keys, "rows": np.bincount(code, minlength=len(keys)), "first": first, "last": last, "total": np.bincount(code, weights=a, minlength=len(keys))}


def _by_block(p: Block, node: int) -> pa.RecordBatch:
    """One row per block of keys."""
    h = (p["keys"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
    block = (h % np.uint64(BLOCKS)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block = block[order]
    start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[start, len(block)], pa.int32())
    schema = to_arrow_schema(_PARTS)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(p[c][order], schema.field(c).type.value_type)).cast(schema.field(c).type) for c in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(block[start]), pa.array(np.full(len(start), node)), *lists], schema=schema)


def _blocks(table: pa.Table) -> list[Block]:
    return [{c: np.asarray(table.column(c)[i].values) for c in _FIELDS} for i in range(table.num_rows)]


def key_totals(df: DataFrame, key: str, us: str | None = None, amount: str | None = None) -> DataFrame:
    """(key, rows, first_us, last_us, total): rows of each key, first and last ``us``, sum of the non-null ``amount``.

    ``key`` is integral. Every input split, of equal size whatever its keys, encodes the keys it meets by a dictionary of
    its own and counts into dense arrays by ``bincount`` and scatter-reduce; arrays go on in blocks of keys and are summed
    in a reduction tree, so no task sees the rows of a key and none the keys of all. One pass over the table, the same
    for few and for many keys. Rows with a null key are left out. Null times and amounts count as rows only. Empty input
    gives no rows.
    """
    us_c = F.col(us) if us else F.lit(None).cast("long")
    am_c = F.col(amount).cast("double") if amount else F.lit(None).cast("double")
    rows = df.select(F.col(key).cast("long").alias("k"), us_c.cast("long").alias("u"), am_c.alias("a")).filter("k IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, node = [], TaskContext.get().partitionId()
        for b in batches:
            u = b.column("u")
            held.append(_count(b.column("k").to_numpy(), u.fill_null(0).to_numpy(), u.is_valid().to_numpy(zero_copy_only=False), np.nan_to_num(b.column("a").to_numpy(zero_copy_only=False).astype(float))))
            if len(held) >= FAN_IN:
                held = [_reduce(held)]
                if len(held[0]["keys"]) > HELD_KEYS:
                    yield _by_block(held.pop(), node)
        if held:
            yield _by_block(_reduce(held), node)

    def merge(table: pa.Table) -> pa.Table:
        up = table.column("node")[0].as_py() // FAN_IN
        return pa.Table.from_batches([_by_block(_reduce(_blocks(table)), up)])

    parts = rows.mapInArrow(count, _PARTS)
    n = max(2, rows.rdd.getNumPartitions())
    while n > 1:
        parts = parts.withColumn("up", F.floor(F.col("node") / FAN_IN)).groupBy("block", "up").applyInArrow(lambda t: merge(t.drop_columns("up")), _PARTS)
        n = -(-n // FAN_IN)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in _blocks(pa.Table.from_batches([b])):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p["keys"]), pa.array(p["rows"]), pa.array(p["first"], mask=p["first"] == _NONE_FIRST), pa.array(p["last"], mask=p["last"] == _NONE_LAST), pa.array(p["total"], pa.float64())],
                    names=[key, "rows", "first_us", "last_us", "total"],
                )

    return parts.mapInArrow(decode, f"`{key}` long, rows long, first_us long, last_us long, total double")


def heavy_keys(df: DataFrame, key: str, share: float = 0.02) -> DataFrame:
    """Keys that hold at least ``share`` of all rows with a key; (key, rows). One pass: the total is the sum of the arrays."""
    totals = materialize(key_totals(df, key))
    n = totals.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    return totals.filter(F.col("rows") >= n * share).select(key, "rows")
