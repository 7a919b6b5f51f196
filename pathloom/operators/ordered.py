"""Linear scans over rows in a total order, without gathering a key in one task.

``repartitionByRange`` over the whole order cuts the data into slices of about equal size whatever the skew of the
leading key, so one entity that holds a third of all rows is spread over a third of the slices. A kernel sees one slice
as numpy arrays. What it can't decide near the slice's ends is handed on as *border rows*; these few rows (and not the
data) are shuffled once more, grouped by border, and decided there with both sides in view.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize

#: Rows in a slice; a slice of narrow rows takes a few dozen MB in a Python worker.
SLICE_ROWS = 200_000

Arrays = dict[str, np.ndarray]


def slice_count(n_rows: int, slice_rows: int = SLICE_ROWS) -> int:
    return max(1, ceil(n_rows / slice_rows))


def sliced(df: DataFrame, order: list[str], n_rows: int, slice_rows: int = SLICE_ROWS, cut: list[str] | None = None) -> DataFrame:
    """``df`` cut into slices of its total order, each sorted. Slice numbers follow the order.

    With ``cut``, leading columns of the order, rows that are equal in these stay in one slice.
    """
    return df.repartitionByRange(slice_count(n_rows, slice_rows), *(cut or order)).sortWithinPartitions(*order)


def to_arrays(table: pa.Table) -> Arrays:
    """Columns as numpy arrays; null numbers become NaN."""
    return {n: table.column(n).to_numpy() for n in table.column_names}


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """Arrays by name as a batch of ``schema``; NaN and NaT stay values, masked arrays give nulls."""
    def one(x, t):
        if isinstance(x, np.ma.MaskedArray):
            return pa.array(x.data, type=t, mask=np.ma.getmaskarray(x), from_pandas=False)
        return x if isinstance(x, pa.Array) else pa.array(x, type=t, from_pandas=False)

    return pa.RecordBatch.from_arrays([one(columns[f.name], f.type) for f in schema], schema=schema)


def edges_at(arrays: Arrays, breaks: np.ndarray) -> tuple[int, int]:
    """Rows before the first break and from the last break on. ``breaks[i]``: nothing spans rows i-1 and i."""
    at = np.flatnonzero(breaks[1:]) + 1
    return (int(at[0]), len(breaks) - int(at[-1])) if len(at) else (len(breaks), 0)


def ordered_scan(
    df: DataFrame,
    order: list[str],
    result: T.StructType,
    kernel: Callable[[Arrays, np.ndarray], dict],
    *,
    n_rows: int,
    halo: int | None = None,
    breaks: Callable[[Arrays], np.ndarray] | None = None,
    edges: Callable[[Arrays], tuple[int, int, int, int] | None] | None = None,
    whole: Callable[[Arrays, int], dict] | None = None,
    cut: list[str] | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Run ``kernel`` over all rows in ``order`` and return its result rows.

    ``kernel(arrays, own)`` gets successive rows and says what it finds for the rows marked in ``own``. Either ``halo``
    is given (a row is decided by at most so many rows on each side), or ``breaks`` (rows on two sides of a break never
    belong together; everything between two breaks is decided together). With ``breaks`` a kernel may also look at the
    row before a break, to say how the first row after it was reached: unless the input starts there, it is shown. Or
    ``edges(arrays)`` says for a slice which rows it can't decide: (a, b, c, d), where rows before ``a`` are decided at the
    border before it with rows up to ``b`` in view, and rows from ``c`` on at the border after it with rows from ``d`` on;
    None if the slice can't be cut.

    ``whole(arrays, slice)`` gives further result rows for each slice by itself, such as what its first and last runs are,
    for questions that no halo bounds. ``cut`` is passed to :func:`sliced`.

    Empty input gives no rows. Slices too short to be cut are joined to their neighbours, so tiny and lopsided inputs
    give the same rows as one slice would.
    """
    assert sum(x is not None for x in (halo, breaks, edges)) == 1
    n = slice_count(n_rows, slice_rows)
    # a row is a result or raw, and the other is null, so all fields may be null, whatever the input and the result say
    result, raw_schema = result.toNullable(), df.schema.toNullable()
    out = T.StructType([T.StructField("res", result), T.StructField("raw", raw_schema), T.StructField("own", T.BooleanType()), T.StructField("slice", T.LongType()), T.StructField("chain", T.LongType())])
    a_res, a_raw, a_out = to_arrow_schema(result), to_arrow_schema(raw_schema), to_arrow_schema(out)

    def wrap(res: pa.RecordBatch | None, raw: pa.Table | None, own, at: int, chain) -> pa.RecordBatch:
        k = res.num_rows if res is not None else raw.num_rows
        r = res.to_struct_array() if res is not None else pa.nulls(k, a_out.field("res").type)
        w = raw.combine_chunks().to_batches()[0].to_struct_array() if raw is not None else pa.nulls(k, a_out.field("raw").type)
        o = pa.array(own, pa.bool_()) if own is not None else pa.nulls(k, pa.bool_())
        return pa.RecordBatch.from_arrays([r.cast(a_out.field("res").type), w.cast(a_out.field("raw").type), o, pa.array(np.full(k, at)), pa.array(np.full(k, chain), pa.int64()) if chain is not None else pa.nulls(k, pa.int64())], schema=a_out)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        table = pa.Table.from_batches(kept).combine_chunks().cast(a_raw)
        arrays, k, at = to_arrays(table), table.num_rows, TaskContext.get().partitionId()
        if whole is not None:
            more = to_batch(whole(arrays, at), a_res)
            if more.num_rows:
                yield wrap(more, None, None, at, None)
        if n == 1:
            yield wrap(to_batch(kernel(arrays, np.ones(k, bool)), a_res), None, None, 0, None)
            return
        if halo is not None:
            at_edges = None if k < 4 * halo else (halo, 2 * halo, k - halo, k - 2 * halo)
        elif breaks is not None:
            head, tail = edges_at(arrays, breaks(arrays))
            # the row before the last break goes along unowned, so the first row after it is seen with its predecessor
            at_edges = None if tail == 0 else (head, head, k - tail, k - tail - 1)
        else:
            at_edges = edges(arrays)
        if at_edges is None:
            yield wrap(None, table, np.ones(k, bool), at, 0)
            return
        first, seen, last, back = at_edges
        own = np.ones(k, bool)
        own[:first] = own[last:] = False
        yield wrap(to_batch(kernel(arrays, own), a_res), None, None, at, None)
        for lo, hi, chain, mine in ((0, seen, 0, lambda i: i < first), (back, k, 1, lambda i: i >= last)):
            yield wrap(None, table.slice(lo, hi - lo), mine(np.arange(lo, hi)), at, chain)

    first = sliced(df, order, n_rows, slice_rows, cut).mapInArrow(scan, out)
    if n == 1:
        return first.filter("res IS NOT NULL").select("res.*")
    first = materialize(first)

    def decide(table: pa.Table) -> pa.Table:
        # tables of one chain: rows of both sides of a border, with all slices between that couldn't be cut
        raw = pa.Table.from_batches([pa.RecordBatch.from_struct_array(c) for c in table.column("raw").chunks], schema=a_raw) if table.num_rows else pa.Table.from_batches([], schema=a_raw)
        # with breaks, an unowned row stands before all others, also before one of equal order
        keys = order if breaks is None else [*order, "__own"]
        raw = raw.append_column("__own", table.column("own").cast(pa.int8())).sort_by([(c, "ascending") for c in keys])
        own = raw.column("__own").to_numpy().astype(bool)
        return pa.Table.from_batches([to_batch(kernel(to_arrays(raw.drop_columns("__own")), own), a_res)], schema=a_res)

    # A slice that was cut separates the border before it from the one after it; the number of such slices so far
    # numbers the borders. One row a slice is ordered here.
    border = first.filter("raw IS NOT NULL").select("raw", "own", "slice", "chain")
    slices = border.groupBy("slice").agg(F.max("chain").alias("cut"))
    before = F.coalesce(F.sum("cut").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chained = border.join(slices.select("slice", before.alias("before")), "slice").select("raw", "own", (F.col("before") + F.col("chain")).alias("chain"))
    second = chained.groupBy("chain").applyInArrow(decide, result)
    return first.filter("res IS NOT NULL").select("res.*").unionByName(second)


def with_previous(df: DataFrame, entity: str, order: list[str], columns: list[str], *, n_rows: int, prefix: str = "prev_") -> DataFrame:
    """``df`` with the named columns of each row's previous row of the same entity (null for an entity's first row).

    As a lag over (entity, order), but through an ordered scan: rows of a heavy entity are spread over slices. All
    columns of ``order``, as of ``entity``, must be integral and not null; their combination should be unique.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    keys = [entity, *order]
    types = {f.name: f for f in df.schema}
    schema = StructType([*df.schema.fields, *(StructField(prefix + c, types[c].dataType) for c in columns), StructField(prefix + "row", LongType())]).toNullable()
    plain = [f.name for f in df.schema]

    arrow = to_arrow_schema(StructType(schema.fields))

    def column(x: np.ndarray, t: pa.DataType, gone: np.ndarray):
        null = gone.copy()
        if x.dtype.kind == "f":
            null |= np.isnan(x)
            x = np.where(null, 0, x) if pa.types.is_integer(t) else x
        elif x.dtype.kind == "O":
            null |= np.array([v is None for v in x], bool)
        return pa.array(x.astype(t.to_pandas_dtype()) if pa.types.is_integer(t) else x, type=t, mask=null, from_pandas=False)

    def kernel(a: Arrays, own: np.ndarray) -> dict:
        at = np.flatnonzero(own)
        prev = np.maximum(at - 1, 0)
        first = (at == 0) | (a[entity][prev] != a[entity][at]) if len(at) else np.zeros(0, bool)
        none = np.zeros(len(at), bool)
        out = {c: column(a[c][at], arrow.field(c).type, none) for c in plain}
        out |= {prefix + c: column(a[c][prev], arrow.field(c).type, first) for c in columns}
        out[prefix + "row"] = pa.array(np.where(first, 0, 1))
        return out

    return ordered_scan(df, keys, schema, kernel, n_rows=n_rows, halo=1).drop(prefix + "row")


def numbered(df: DataFrame, order: list[str], *, n_rows: int, name: str = "row_id", start: int = 1, weight: str | None = None) -> DataFrame:
    """``df`` with a dense row number over a total order, without a single-task window: ranges are counted, then offset.

    With ``weight``, a count that isn't null, a row stands for so many rows and gets the number of the first of them.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("__slice", T.LongType()), T.StructField("__at", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            k = b.column(weight).to_numpy() if weight else np.ones(b.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, at)), pa.array(seen + np.cumsum(k) - k)], names=[*b.schema.names, "__slice", "__at"])
            seen += int(k.sum())

    rows = materialize(sliced(df, order, n_rows).mapInArrow(count, schema))
    per = rows.groupBy("__slice").agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    offset = per.select("__slice", F.coalesce(F.sum("n").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    return rows.join(offset, "__slice").withColumn(name, F.col("__offset") + F.col("__at") + start).drop("__slice", "__at", "__offset")
