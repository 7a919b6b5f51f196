"""Laying items of varying length into containers of fixed capacity.

Only the multiset of lengths matters for the plan, and it has at most ``capacity`` entries however many items there are.
Minimum bin slack: the longest remaining length opens a container, and a bitset subset-sum over the remaining lengths
(with their counts) finds the multiset that fills the rest closest. The pattern found, with counts backtracked from the
bitsets, is repeated as often as the counts allow. Items then take their places by their rank among items of their
length; ranks come from counts per partition, so no length, however common, is gathered.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@cache
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: The split pattern published with the byte-level BPE vocabulary; a fixed value.
BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(docs: DataFrame, key: str, text: str = "text", path: str = TOKENIZER_FILE, pattern: str = BPE_PATTERN) -> DataFrame:
    """(key, n_tokens) of every text under a public byte-level BPE; null and empty texts have 0 tokens."""

    # shipped to every executor, which needn't have it
    docs.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(SparkFiles.get(name), pattern)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    return docs.select(key, text).mapInArrow(count, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long")


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: items}, containers) that use up ``counts`` (lengths in 1..capacity).

    The longest length left opens a container; all lengths left are offered for the rest of it, with their counts. Each
    pattern uses up a length or leaves fewer of it than it needs, so there are few patterns however many items.
    """
    left = {k: v for k, v in sorted(counts.items(), reverse=True) if v > 0}
    patterns: list[tuple[dict[int, int], int]] = []
    while left:
        top = next(iter(left))  # lengths stay in falling order
        left[top] -= 1
        use = _closest(left, capacity - top)
        left[top] += 1
        use[top] = use.get(top, 0) + 1
        times = min(left[k] // v for k, v in use.items())
        for k, v in use.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
        patterns.append((use, times))
    return patterns


def _closest(pool: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of ``pool`` (length: count, in falling order) whose sum comes closest to ``room`` from below, by bitset
    subset-sum.

    Long lengths are offered first, so short ones, which fit anywhere, are kept for later. Counts are binary split. Once
    the room can be filled exactly nothing better can come.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for k, count in pool.items():
        if k > room:
            continue
        most, part = min(count, room // k), 1
        while most > 0:
            take = min(part, most)
            new = (reach | (reach << (k * take))) & mask
            if new != reach:
                steps.append((k, take, reach))
                reach = new
            most -= take
            part *= 2
        if reach >> room & 1:
            break
    at, pick = reach.bit_length() - 1, {}
    for k, take, before in reversed(steps):
        if not before >> at & 1:
            pick[k] = pick.get(k, 0) + take
            at -= k * take
    return pick


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(container_id, key, piece, start, length): a place for every piece of every item.

    An item of at most ``capacity`` is one piece. A longer one is cut into full pieces and a rest. Items of null, zero
    or negative size need no room and get no place. Repeated keys are separate items. Container numbers are dense from 0.
    Empty input gives no rows.
    """
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("s") - 1) / capacity).cast("long")))
    pieces = items.select(F.col(key).alias("k"), F.col(size).cast("long").alias("s")).filter("s > 0").withColumn("piece", cut).select("k", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("s") - F.col("piece") * capacity).alias("length"))
    schema = f"k {items.schema[key].dataType.simpleString()}, piece long, start long, length long"

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        at = TaskContext.get().partitionId()
        for b in batches:
            n = b.column(3).to_numpy()
            order = np.argsort(n, kind="stable")
            s = n[order]
            first = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
            within = np.arange(len(s)) - np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
            r = np.empty(len(s), np.int64)
            r[order] = within + seen[s]
            seen += np.bincount(n, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r), pa.array(np.full(len(s), at))], names=["k", "piece", "start", "length", "rank", "part"])

    # written once, so ranks within a partition stand whatever is computed again
    ranked = materialize(pieces.mapInArrow(rank, schema + ", rank long, part long"))
    part = ranked.groupBy("length", "part").agg(F.count("*").alias("n"))
    part = part.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    part = materialize(part)
    assert capacity < 1 << 13, "the plan is made for lengths below 2**13"
    # at most `capacity` rows: the histogram of lengths
    counts = {int(r["length"]): int(r["n"]) for r in part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    patterns = plan_patterns(counts, capacity)
    # per length its patterns' first ranks, first containers and items a container, one after another: bounded like the patterns
    rows: list[tuple[int, int, int, int]] = []
    used: dict[int, int] = {}
    container = 0
    for use, times in patterns:
        for k, v in use.items():
            rows.append((k, used.get(k, 0), container, v))
            used[k] = used.get(k, 0) + v * times
        container += times
    rows.sort()
    lengths, firsts, containers, each = np.array(rows, np.int64).reshape(-1, 4).T
    shared = items.sparkSession.sparkContext.broadcast((lengths, firsts, containers, each))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, start, per = shared.value
        # one number orders (length, rank); ranks are below 2**50
        at = length * (1 << 50) + first
        for b in batches:
            n, r = b.column(3).to_numpy(), b.column(4).to_numpy()
            j = np.searchsorted(at, n * (1 << 50) + r, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(start[j] + (r - first[j]) // per[j]), *b.columns[:4]], names=["container_id", key, "piece", "start", "length"])

    placed = ranked.join(F.broadcast(part.select("length", "part", "offset")) if ranked.rdd.getNumPartitions() * capacity <= 2_000_000 else part.select("length", "part", "offset"), ["length", "part"])
    placed = placed.select("k", "piece", "start", "length", (F.col("rank") + F.col("offset")).alias("rank"))
    return placed.mapInArrow(place, f"container_id long, `{key}` {items.schema[key].dataType.simpleString()}, piece long, start long, length long")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, used, free and free share of all room, and the fewest containers that could do."""
    t = packed.agg(F.countDistinct("container_id").alias("containers"), F.coalesce(F.sum("length"), F.lit(0)).alias("used"))
    return t.select("containers", "used", (F.col("containers") * capacity - F.col("used")).alias("free"), F.try_divide(F.col("containers") * capacity - F.col("used"), F.col("containers") * capacity).alias("free_share"), F.ceil(F.col("used") / capacity).alias("fewest"))
