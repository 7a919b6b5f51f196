"""Long exact spans shared between records.

Windows are hashed only where their position modulo a period lies in a difference cover: for any two positions some
common shift below the period brings both onto the cover, so two records that share a span of at least the wanted length
share an aligned, hashed window inside it. Equal hashes are candidates; both texts are then compared outward from the
anchor, character by character. Windows shared by many records would give all pairs of them; these are told apart by the
hashes of all windows of the full wanted length around the anchor, so only true pairs are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, small

#: More records than this on one window are told apart by longer windows instead of being paired at once.
CROWD = 24
#: Windows a task gets on average.
TASK_WINDOWS = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1


def difference_cover(period: int) -> list[int]:
    """Residues whose pairwise differences give every residue of ``period``.

    For a period q*q + q + 1 with q prime the smallest there are, q + 1 of them: exponents of a generator of the cubic
    field over q whose powers lie in a plane. Otherwise by greedy search (about 1.3 times as many).
    """
    q = int(round((-1 + (4 * period - 3) ** 0.5) / 2))
    if q * q + q + 1 == period and all(q % d for d in range(2, q)) and q > 1:
        for a, b, c in ((a, b, c) for a in range(q) for b in range(q) for c in range(1, q)):  # theta^3 = a theta^2 + b theta + c
            x, found = (1, 0, 0), []
            for i in range(period):
                if x[2] == 0:
                    found.append(i)
                x = (c * x[2] % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
            if len(found) == q + 1 and len({(i - j) % period for i in found for j in found}) == period:
                return found
    cover, missing = [0], set(range(1, period))
    while missing:
        gain = lambda r: len({(r - c) % period for c in cover} & missing | {(c - r) % period for c in cover} & missing)
        best = max((r for r in range(period) if r not in cover), key=lambda r: (gain(r), -r))
        missing -= {(best - c) % period for c in cover} | {(c - best) % period for c in cover}
        cover.append(best)
    return sorted(cover)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mix(c: np.ndarray) -> np.ndarray:
    """Code points spread over 64 bits."""
    x = c.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            one = np.ones(1, np.uint64)
            self.up = np.r_[one, np.cumprod(np.full(n - 1, _BASE, np.uint64), dtype=np.uint64)]
            self.down = np.r_[one, np.cumprod(np.full(n - 1, pow(_BASE, -1, 2**64), np.uint64), dtype=np.uint64)]
        return self.up, self.down


def _prefix(x: np.ndarray, powers: _Powers) -> np.ndarray:
    up, _ = powers.to(len(x) + 1)
    s = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[: len(x)], out=s[1:])
    return s


def _hashes(s: np.ndarray, at: np.ndarray, width: int, powers: _Powers) -> np.ndarray:
    """Hashes of the windows that begin at ``at``, the same for equal windows anywhere."""
    h = (s[at + width] - s[at]) * powers.to(len(s))[1][at]
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def shared_matches(docs: DataFrame, key: str, text: str, span: int, period: int) -> DataFrame:
    """(a, b, start_a, start_b, length), a < b: every longest exact match of at least ``span`` characters."""
    cover, width = np.array(difference_cover(period)), span - period + 1
    assert width > 0
    kind = docs.schema[key].dataType.simpleString()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in batches:
            keys, hs, ks, ps = b.column(0).to_pylist(), [], [], []
            for k, t in zip(keys, b.column(1).to_pylist(), strict=True):
                if t is None or len(t) < span:
                    continue
                s = _prefix(_mix(_codes(t)), powers)
                last = len(t) - width
                at = (np.arange(0, last + 1, period)[:, None] + cover).ravel()
                at = at[at <= last]
                hs.append(_hashes(s, at, width, powers))
                ps.append(at.astype(np.int32))
                ks.append(np.full(len(at), k))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.concatenate(ks)), pa.array(np.concatenate(ps))], names=["h", "k", "p"])

    found = docs.select(key, text).mapInArrow(anchors, f"h long, k {kind}, p int")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (h, k, p): pairs of small groups, members of crowded ones.

        A window stands in a record about once, so of the windows of all records one window's rows are a small part even
        if it stands in all of them; and a group is held only until it proves crowded, then its rows pass through.
        """
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shift", pa.int32()), ("pa", pa.int32())])
        held: list[np.ndarray] | None = None  # the last group, which may go on
        crowd_h: int | None = None  # the window whose rows pass through

        def members(k, p):
            return k, np.full(len(k), -1), np.zeros(len(k), np.int32), p

        def group(k, p):
            n = len(np.unique(k))
            if n < 2:
                return None
            if n > CROWD:
                return members(k, p)
            i, j = np.nonzero(k[:, None] < k[None, :])
            return k[i], k[j], p[j] - p[i], np.zeros(len(i), np.int32)

        def batch(parts):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*parts, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(3)]
            parts = []
            if crowd_h is not None and len(cols[0]):
                n = int(np.searchsorted(cols[0], crowd_h, side="right")) if cols[0][0] == crowd_h else 0
                if n:
                    parts.append(members(cols[1][:n], cols[2][:n]))
                    cols = [c[n:] for c in cols]
                if len(cols[0]):
                    crowd_h = None
            if len(cols[0]):
                if held is not None:
                    cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
                h = cols[0]
                new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                sizes = np.diff(np.r_[new, len(h)])
                for s, n in zip(new[:-1].tolist(), sizes[:-1].tolist(), strict=True) if (sizes[:-1] > 1).any() else ():
                    if n > 1 and (got := group(cols[1][s : s + n], cols[2][s : s + n])) is not None:
                        parts.append(got)
                held = [c[new[-1] :] for c in cols]
                if len(np.unique(held[1])) > CROWD:
                    parts.append(members(held[1], held[2]))
                    crowd_h, held = int(held[0][0]), None
            if parts:
                yield batch(parts)
        if held is not None and (got := group(held[1], held[2])) is not None:
            yield batch([got])

    # by the number of windows, so that a task's share of them is bounded
    chars = docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n")).first()["n"]
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int(chars * len(cover) / period / TASK_WINDOWS))
    ordered = found.repartition(parts, "h").sortWithinPartitions("h", "k", "p")
    links = materialize(ordered.mapInArrow(meet, "a long, b long, shift int, pa int"))
    lines = links.filter("b >= 0").select("a", "b", "shift").distinct()
    texts = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).filter("t IS NOT NULL")
    crowd = links.filter("b < 0").select(F.col("a").alias("k"), F.col("pa").alias("p"))
    if crowd.limit(1).count():
        lines = lines.unionByName(_tell_apart(crowd, texts, span, width)).distinct()
    # a pair's texts meet once, whatever its shifts
    lines = lines.groupBy("a", "b").agg(F.collect_set("shift").alias("shifts"))

    # texts of the few records in candidate pairs only, written once
    lines = materialize(lines)
    wanted = materialize(lines.select(F.explode(F.array("a", "b")).alias("k")).distinct())
    texts = materialize(texts.join(F.broadcast(wanted) if small(wanted) else wanted, "k", "left_semi"))

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, shifts, x, y in zip(pdf["a"], pdf["b"], pdf["shifts"], pdf["ta"], pdf["tb"], strict=True):
                x, y = _codes(x), _codes(y)
                for shift in map(int, shifts):
                    lo, hi = max(0, -shift), min(len(x), len(y) - shift)  # where both texts have characters, in a's positions
                    if hi - lo < span:
                        continue
                    same = np.r_[False, x[lo:hi] == y[lo + shift : hi + shift], False]
                    turn = np.flatnonzero(same[1:] != same[:-1])
                    s, e = turn[::2], turn[1::2]
                    keep = e - s >= span
                    out += [(a, b, lo + i, lo + i + shift, j - i) for i, j in zip(s[keep].tolist(), e[keep].tolist(), strict=True)]
            yield pd.DataFrame(out, columns=["a", "b", "start_a", "start_b", "length"]).astype("int64")

    ta, tb = texts.select(F.col("k").alias("a"), F.col("t").alias("ta")), texts.select(F.col("k").alias("b"), F.col("t").alias("tb"))
    return lines.join(ta, "a").join(tb, "b").select("a", "b", "shifts", "ta", "tb").mapInPandas(extend, "a long, b long, start_a long, start_b long, length long")


def _tell_apart(crowd: DataFrame, texts: DataFrame, span: int, width: int) -> DataFrame:
    """Pairs of a crowded window whose records agree on a whole span around it, as candidate lines."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in batches:
            hs, ks, ps = [], [], []
            for k, ats, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                s = _prefix(_mix(_codes(t)), powers)
                at = np.unique((np.array(ats)[:, None] - np.arange(span - width + 1)).ravel())
                at = at[(at >= 0) & (at + span <= len(t))]
                hs.append(_hashes(s, at, span, powers))
                ks.append(np.full(len(at), k))
                ps.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.concatenate(ks)), pa.array(np.concatenate(ps))], names=["h", "k", "p"])

    rows = crowd.groupBy("k").agg(F.collect_set("p").alias("at")).join(texts, "k").select("k", "at", "t").mapInArrow(spans, "h long, k long, p int")
    rows = materialize(rows)
    left, right = rows.select("h", F.col("k").alias("a"), F.col("p").alias("pa")), rows.select("h", F.col("k").alias("b"), F.col("p").alias("pb"))
    return left.join(right, "h").filter("a < b").select("a", "b", (F.col("pb") - F.col("pa")).alias("shift")).distinct()


def copies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, leader) of every record whose text stands in several records; the leader has the smallest key."""
    h = docs.filter(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.md5(text).alias("h"))
    # partial minima first, so a text in a third of all records is no single task's
    groups = h.groupBy("h").agg(F.min("doc").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("h", "leader")
    groups = materialize(groups)
    return materialize(h.join(F.broadcast(groups) if small(groups) else groups, "h").select("doc", "leader"))


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = 300, period: int = 133) -> tuple[DataFrame, DataFrame]:
    """(matches, copies): longest exact matches of at least ``span`` code points between distinct texts, and which
    records repeat which text.

    Matches are between leaders, (a, b, start_a, start_b, length) with a < b. Every record of a text takes part in its
    leader's matches. ``key`` must be integral, non-negative and unique. Null texts and texts shorter than the span have
    no matches; empty input gives none. ``period`` must be at most ``span``; any value gives the same rows.
    """
    same = copies(docs, key, text)
    later = same.filter("doc <> leader").select(F.col("doc").alias(key))
    once = docs.join(F.broadcast(later) if small(later) else later, key, "left_anti")
    return shared_matches(once, key, text, span, period), same


def shared_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = 300, period: int = 133) -> DataFrame:
    """(key_a, key_b), key_a < key_b, of all records that share a span, copies of a text included."""
    matches, same = shared_spans(docs, key, text, span, period)
    pairs = matches.select("a", "b").distinct()
    if not same.limit(1).count():
        return pairs.select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"))
    long = docs.filter(F.length(text) >= span).select(F.col(key).cast("long").alias("doc"))
    same = materialize(same.join(long, "doc", "left_semi"))
    members = lambda c: same.select(F.col("leader").alias(c), F.col("doc").alias(f"{c}_doc"))
    wide = pairs.join(members("a"), "a", "left").join(members("b"), "b", "left").select(F.coalesce("a_doc", "a").alias("x"), F.coalesce("b_doc", "b").alias("y"))
    inside = same.select("leader", F.col("doc").alias("x")).join(same.select("leader", F.col("doc").alias("y")), "leader").filter("x < y").select("x", "y")
    return wide.unionByName(inside).select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).distinct()


def shared_report(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = 300, period: int = 133) -> DataFrame:
    """One row per record with a text: (key, class_id, n_partners, shared_chars, shared_share).

    ``class_id`` is the smallest key with the same text, ``n_partners`` the number of other records it shares a span
    with (copies counted), ``shared_chars`` how many of its characters stand in such a span elsewhere.
    """
    matches, same = shared_spans(docs, key, text, span, period)
    matches = materialize(matches)
    sizes = same.groupBy(F.col("leader").alias("other")).agg(F.count("*").alias("copies"))
    both = matches.select(F.col("a").alias("leader"), F.col("b").alias("other"), F.col("start_a").alias("s"), "length").unionByName(matches.select(F.col("b").alias("leader"), F.col("a").alias("other"), F.col("start_b").alias("s"), "length"))
    partners = both.select("leader", "other").distinct().join(sizes, "other", "left").groupBy("leader").agg(F.sum(F.coalesce("copies", F.lit(1))).alias("others"))
    merged = F.aggregate(F.array_sort(F.collect_list(F.struct("s", (F.col("s") + F.col("length")).alias("e")))), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["e"]).alias("to")))
    covered = both.groupBy("leader").agg(merged.alias("m")).select("leader", F.col("m.n").alias("chars"))
    base = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.col(key).cast("long").alias("doc"), F.length(text).cast("long").alias("len"))
    own = same.join(same.groupBy("leader").agg(F.count("*").alias("n")), "leader")
    j = base.join(own, "doc", "left").withColumn("leader", F.coalesce("leader", "doc")).join(partners, "leader", "left").join(covered, "leader", "left")
    copy = F.coalesce(F.col("n") - 1, F.lit(0))
    whole = (copy > 0) & (F.col("len") >= span)
    chars = F.when(whole, F.col("len")).otherwise(F.coalesce("chars", F.lit(0)))
    return j.select(F.col("__key").alias(key), F.col("leader").alias("class_id"), (F.coalesce("others", F.lit(0)) + F.when(whole, copy).otherwise(0)).alias("n_partners"), chars.alias("shared_chars"), F.coalesce(F.try_divide(chars, F.col("len")), F.lit(0.0)).alias("shared_share"))
