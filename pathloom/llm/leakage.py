"""Passages of evaluation items inside a corpus.

A prefix-filtered set join on word shingles. Shingles of each item are ordered by rarity in the corpus; a document that
holds enough of an item must hold one of the item's rarest shingles, as many as the needed overlap leaves (its prefix).
Only prefix shingles are joined; candidates must then pass the length bound, hold enough of the item's shingles, and
hold them in one or two windows of about the item's size. What is left is verified in the text: enough
of the item's words must stand in these windows in its order, and then in one or two passages by alignment.

Texts are folded and cut into words as arrays of code points; a word is a 64-bit hash, a shingle a hash of these. Of the
items every task gets only a bitmap of fixed size; items, rarities and candidates stay tables.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import lookup_join, materialize
from .spans import _mix, _Powers

_BLOCK_TAG = re.compile(r"</?(?:p|br|div|li|ul|ol|td|tr|table|h[1-6]|hr)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_BROKEN = re.compile(r"-(?<=[^\W\d_]-)[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
#: Code points without width, taken out of words.
_NO_WIDTH = {0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF}
#: Characters folded at once, code points folded in advance, bits (as a power of two) of the shingle bitmap.
CHUNK, EAGER, BITMAP = 1 << 20, 0x3000, 24
#: Cells of alignment tables filled together.
CELLS = 1 << 20
_A = np.uint64(0x9E3779B97F4A7C15 | 1)


@dataclass(frozen=True)
class LeakRules:
    share: float = 0.5  #: part of the item's words a document must hold
    shingle: int = 3  #: words in a shingle; short, as words change within passages
    overlap: float = 0.12  #: part of the item's shingles that must be left intact
    least_words: int = 9  #: half of a shorter item, in two passages, may hold no shingle: such items are joined on words


def plain(text: str) -> str:
    """Text without mark-up, and with words broken at line ends put together."""
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if "&" in text:
        text = html.unescape(text)
    return _BROKEN.sub("", text) if "-" in text and "\n" in text else text


class Folding:
    """Words whatever the letter case, punctuation, mark-up, line breaks and Unicode forms, as 64-bit hashes.

    Every code point is folded for itself (compatibility decomposition, case folding, marks taken off): to one code
    point, to none, to several, or to a separator if it is neither letter nor digit.
    """

    def __init__(self) -> None:
        self.value = np.zeros(0x110000, np.uint64)  # 0: separator
        self.special = np.zeros(0x110000, np.uint8)  # 1: vanishes, 2: several
        self.several: dict[int, list[int]] = {}
        self.late = np.zeros(0x110000, bool)
        self.late[EAGER:] = True
        self.powers = _Powers()
        self.learn(range(EAGER))

    def learn(self, points) -> None:
        points = list(points)
        mixed = _mix(np.array(points, np.uint32))
        for p, m in zip(points, mixed, strict=True):
            self.late[p] = False
            to = [] if p in _NO_WIDTH else [c for c in unicodedata.normalize("NFKD", chr(p)).casefold() if not unicodedata.combining(c)]
            if not to:
                self.special[p] = 1
            elif len(to) > 1:
                self.special[p] = 2
                self.several[p] = [ord(c) for c in to]
                self.learn(q for q in self.several[p] if self.late[q])
            elif to[0].isalnum():
                self.value[p] = m if ord(to[0]) == p else _mix(np.array([ord(to[0])], np.uint32))[0]

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, offsets: words of text i are offsets[i]..offsets[i+1])."""
        joined = "\n".join(texts)
        ends = np.cumsum([len(t) + 1 for t in texts])
        if joined.isascii():
            points = np.frombuffer(joined.encode(), np.uint8)
        else:
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            new = np.flatnonzero(self.late[points])
            if len(new):
                self.learn(np.unique(points[new]).tolist())
            special = self.special[points]
            if special.any():
                times = np.ones(len(points), np.int64)
                times[special == 1] = 0
                at = np.flatnonzero(special == 2)
                wide = [self.several[int(p)] for p in points[at]]
                times[at] = [len(w) for w in wide]
                to = np.r_[0, np.cumsum(times)]
                points = np.repeat(points, times)
                for k, w in zip(to[at].tolist(), wide, strict=True):
                    points[k : k + len(w)] = w
                ends = to[np.minimum(ends, len(to) - 1)]
        v = self.value[points]
        word = v != 0
        start = np.flatnonzero(word & ~np.r_[False, word[:-1]]) if len(word) else np.zeros(0, np.int64)
        if not len(start):
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        up, down = self.powers.to(len(v) + 1)
        h = np.add.reduceat(v * up[: len(v)], start) * down[start]
        return h ^ (h >> np.uint64(29)), np.r_[0, np.searchsorted(start, ends)]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (0 at the last k - 1 positions)."""
    out = np.zeros(len(h), np.uint64)
    n = len(h) - k + 1
    if n > 0:
        s = h[:n].copy()
        for i in range(1, k):
            s = (s ^ (s >> np.uint64(31))) * _A + h[i : i + n]
        out[:n] = (s ^ (s >> np.uint64(30))) * _A
    return out


def single(h: np.ndarray) -> np.ndarray:
    """Hash of a word as a shingle of its own, apart from those of several words."""
    return (h + np.uint64(0x632BE59BD9B4E019)) * _A


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK`` characters."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= CHUNK:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


Passage = tuple[int, int, int, int, int]


def align_all(jobs: list[tuple[np.ndarray, np.ndarray]]) -> list[Passage]:
    """Best local alignment of each pair of word lists: (matched words, a from, a to, b from, b to), ends exclusive.

    A match earns 2, a changed, added or missing word costs 1. Pairs of similar size are filled together, a row of all
    their tables at once: gaps along a row are a running maximum. What pads a list matches nothing and wins nothing.
    """
    out: list[Passage] = [(0, 0, 0, 0, 0)] * len(jobs)
    order = sorted((i for i, (a, b) in enumerate(jobs) if len(a) and len(b)), key=lambda i: (len(jobs[i][0]), len(jobs[i][1])))
    while order:
        m = len(jobs[order[-1]][0])
        n, take = 0, 0
        for k in range(1, len(order) + 1):
            n = max(n, len(jobs[order[-k]][1]))
            if k > 1 and k * (m + 1) * (n + 1) > CELLS:
                break
            take = k
        lot, order = order[-take:], order[:-take]
        n = max(len(jobs[i][1]) for i in lot)
        a, b = np.zeros((take, m), np.int64), np.ones((take, n), np.int64)
        for r, i in enumerate(lot):
            a[r, : len(jobs[i][0])], b[r, : len(jobs[i][1])] = jobs[i]
        kind = np.int16 if m < 16_000 and n < 16_000 else np.int32
        score, step = np.zeros((m + 1, take, n + 1), kind), np.arange(n, dtype=kind)
        for x in range(m):
            up = score[x]
            t = np.maximum(up[:, :-1] + np.where(b == a[:, x : x + 1], kind(2), kind(-1)), up[:, 1:] - kind(1))
            np.maximum(t, 0, out=t)
            t += step
            np.maximum.accumulate(t, axis=1, out=t)
            score[x + 1, :, 1:] = t - step
        for r, i in enumerate(lot):
            out[i] = _back(jobs[i][0], jobs[i][1], score[:, r])
    return out


def _back(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> Passage:
    i, j = divmod(int(score.argmax()), score.shape[1])
    a1, b1, matched = i, j, 0
    while s := int(score[i, j]):
        same = a[i - 1] == b[j - 1]
        if s == score[i - 1, j - 1] + (2 if same else -1):
            matched += bool(same)
            i, j = i - 1, j - 1
        elif s == score[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return (matched, i, a1, j, b1) if matched else (0, 0, 0, 0, 0)


def parts_of(at: np.ndarray, m: int, n: int) -> list[tuple[int, int]]:
    """Windows around groups of positions, an item's length beyond them on both sides."""
    return [(max(0, int(p[0]) - m), min(n, int(p[-1]) + m)) for p in np.split(at, np.flatnonzero(np.diff(at) > m) + 1)]


def most_held(cases: list[tuple[Item, np.ndarray, np.ndarray]], share: float) -> list[int]:
    """For each (item, text, positions) the most words of the item in one passage, or in two in the item's order.

    In every window around positions: the best passage, the best before it and the best after it in the item's order,
    also of a word. The latter are left out where they can't bring an item to its share.
    """
    places = [(c, lo, hi) for c, (item, doc, at) in enumerate(cases) for lo, hi in parts_of(at, len(item.words), len(doc))]
    found: list[list[Passage]] = [[] for _ in cases]
    first = align_all([(cases[c][0].words, cases[c][1][lo:hi]) for c, lo, hi in places])
    tops = [0] * len(cases)
    for (c, _, _), p in zip(places, first, strict=True):
        tops[c] = max(tops[c], p[0])
    more = []
    for (c, lo, hi), (n, a0, a1, b0, b1) in zip(places, first, strict=True):
        if not n:
            continue
        item, doc, _ = cases[c]
        found[c].append((n, a0, a1, lo + b0, lo + b1))
        m = len(item.words)
        for i0, i1, k0, k1 in ((0, a0, lo, lo + b0), (a1, m, lo + b1, hi)):
            if min(i1 - i0, k1 - k0) > 0 and tops[c] + min(i1 - i0, item.in_order(doc[k0:k1])) >= share * m:
                more.append((c, i0, i1, k0, k1))
    for (c, i0, _, k0, _), (n, a0, a1, b0, b1) in zip(more, align_all([(cases[c][0].words[i0:i1], cases[c][1][k0:k1]) for c, i0, i1, k0, k1 in more]), strict=True):
        if n:
            found[c].append((n, i0 + a0, i0 + a1, k0 + b0, k0 + b1))
    return [held_words(f) for f in found]


class Item:
    """An item's words as the verification needs them."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.sorted, self.at = words, np.unique(words), {}
        for i, w in enumerate(words.tolist()):
            self.at[w] = self.at.get(w, 0) | 1 << i

    def known(self, doc: np.ndarray) -> np.ndarray:
        """Positions of a text that hold a word of the item."""
        j = np.minimum(np.searchsorted(self.sorted, doc), len(self.sorted) - 1)
        return np.flatnonzero(self.sorted[j] == doc)

    def in_order(self, doc: np.ndarray) -> int:
        """Length of the longest common subsequence with a text, by one big-integer step a word."""
        full = (1 << len(self.words)) - 1
        v = full
        for w in doc[self.known(doc)].tolist():
            u = v & self.at[w]
            v = (v + u | v - u) & full
        return len(self.words) - v.bit_count()

    def can_hold(self, doc: np.ndarray, at: np.ndarray, least: float) -> bool:
        """False only if no two passages around positions ``at`` can hold ``least`` words of the item in its order."""
        parts = parts_of(at, len(self.words), len(doc))
        known = self.known(doc)
        n = np.searchsorted(known, [p[1] for p in parts]) - np.searchsorted(known, [p[0] for p in parts])
        if np.sort(n)[-2:].sum() < least:
            return False
        return sum(sorted((self.in_order(doc[lo:hi]) for lo, hi in parts), reverse=True)[:2]) >= least


def held_words(found: list[Passage]) -> int:
    """Most words of an item in one passage, or in two that stand in the item's order."""
    best = max((p[0] for p in found), default=0)
    for p in found:
        for q in found:
            if p[2] <= q[1] and p[4] <= q[3]:
                best = max(best, p[0] + q[0])
    return best


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", rules: LeakRules = LeakRules()) -> DataFrame:
    """(doc_key, item_key, held, words): documents with at least ``rules.share`` of an item's words, in the item's order.

    ``held`` is the number of words found in one or two connected passages, ``words`` the item's number of words. Null
    or wordless texts hold nothing and leak nowhere. Items of fewer than ``rules.least_words`` words, of which a half may
    hold no shingle, are joined on single words. An item key with several texts comes out once a document, with the text
    it holds most of. Equal rows count once. Null keys are left out. Empty tables give no rows.
    """
    k, share, least = rules.shingle, rules.share, rules.least_words
    kind, ikind = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()

    def item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Folding()
        for b in batches:
            h, off = fold.words([plain(t) for t in b.column(2).to_pylist()])
            words = [h[i:j] for i, j in zip(off[:-1], off[1:], strict=True)]
            own = [np.unique((shingles(w, k)[: len(w) - k + 1] if len(w) >= least else single(w)).view(np.int64)) for w in words]
            n = [len(w) for w in words]
            # what a holding document has at least: of all shingles a share, of single words all but the missing half
            need = [max(1, int(np.ceil(rules.overlap * len(o))) if m >= least else len(o) - int((1 - share) * m)) for o, m in zip(own, n, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(need, pa.int32()), pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64())), pa.array(own, pa.list_(pa.int64()))], names=["u", "item", "n", "need", "words", "own"])

    texts = items.filter(F.col(item_key).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(item_key, text).alias("u"), F.col(item_key).alias("item"), F.col(text).alias("t")).dropDuplicates(["u"])
    wanted = materialize(texts.mapInArrow(item_words, f"u long, item {ikind}, n int, need int, words array<long>, own array<long>").filter("n > 0"))
    each = wanted.select("u", "n", "need", F.size("own").alias("size"), F.explode("own").alias("sh"))

    # a bitmap of all shingles: at most 2**BITMAP bits, whatever the number of items
    word = F.shiftrightunsigned("sh", 64 - BITMAP + 6).alias("word")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(sh, {64 - BITMAP}) & 63 AS int))").alias("bit")
    rows = each.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    packed = np.zeros(1 << (BITMAP - 6), np.int64)
    for r in rows:
        packed[r["word"]] = r["bits"]
    singles = bool(wanted.filter(F.col("n") < least).limit(1).count())
    shared = docs.sparkSession.sparkContext.broadcast((np.unpackbits(packed.view(np.uint8), bitorder="little").tobytes(), singles))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, also_single = np.frombuffer(shared.value[0], bool), shared.value[1]
        fold, shift = Folding(), np.uint64(64 - BITMAP)
        for b in batches:
            keys, every = b.column(0), [plain(t) for t in b.column(1).to_pylist()]
            for lo, hi in chunks(every):
                h, off = fold.words(every[lo:hi])
                kinds = [shingles(h, k), *([single(h)] if also_single else [])]
                if len(h):  # no shingle goes over the end of a text
                    for i in range(1, k):
                        kinds[0][np.maximum(off[1:] - i, 0)[off[1:] - i >= off[:-1]]] = 0
                hit = [np.flatnonzero(bits[s >> shift]) for s in kinds]
                pos, sh = np.concatenate(hit), np.concatenate([s[p] for s, p in zip(kinds, hit, strict=True)])
                order = np.argsort(pos, kind="stable")
                pos, sh = pos[order], sh[order]
                cut = np.searchsorted(pos, off)
                some = np.flatnonzero(cut[1:] > cut[:-1])
                if not len(some):
                    continue
                pos = pos - np.repeat(off[:-1], np.diff(cut))
                o = pa.array(np.r_[cut[some], len(pos)], pa.int32())
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo).take(pa.array(some)), pa.array(np.diff(off)[some], pa.int32()), pa.ListArray.from_arrays(o, pa.array(sh.view(np.int64))), pa.ListArray.from_arrays(o, pa.array(pos.astype(np.int32)))], names=["d", "dn", "sh", "pos"])

    hits = materialize(docs.filter(F.col(doc_key).isNotNull() & F.col(text).isNotNull()).select(doc_key, text).mapInArrow(find, f"d {kind}, dn int, sh array<long>, pos array<int>"))
    held = hits.select("d", "dn", F.explode(F.array_distinct("sh")).alias("sh"))
    rarity = held.groupBy("sh").agg(F.count("*").alias("docs"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.coalesce("docs", F.lit(0)), "sh"))
    prefix = each.join(rarity, "sh", "left").withColumn("rank", rank).filter(F.col("rank") <= F.col("size") - F.col("need") + 1).filter("docs IS NOT NULL").select("sh", "u", "n")
    candidates = lookup_join(held, prefix, ["sh"], spread="d").filter(F.col("dn") >= F.col("n") * share).select("d", "u").distinct()
    pairs = lookup_join(candidates.join(hits, "d"), wanted, ["u"], spread="d", width=64 + 8 * (F.size("words") + F.size("own"))).filter(F.size(F.array_intersect("sh", "own")) >= F.col("need"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keeps pairs with enough shingles of the item in the best two windows of its size."""
        for b in batches:
            keep, kept_at = [], []
            for r in range(b.num_rows):
                sh, own, p = (b.column(c)[r].values.to_numpy() for c in ("sh", "own", "pos"))
                j = np.minimum(np.searchsorted(own, sh), len(own) - 1)
                ok = own[j] == sh
                pos, j = p[ok], j[ok]
                end = np.searchsorted(pos, pos + 2 * b.column("n")[r].as_py())
                need = b.column("need")[r].as_py()
                in_window = [len(set(j[s:e].tolist())) for s, e in enumerate(end.tolist())]
                # windows of a pair needn't be apart: this only lets more through
                if 2 * max(in_window) >= need:
                    keep.append(r)
                    kept_at.append(pos)
            if keep:
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("d", "u", "item", "words")), pa.array(kept_at, pa.list_(pa.int32()))], names=["d", "u", "item", "words", "at"])

    some = pairs.select("d", "u", "item", "n", "need", "words", "own", "sh", "pos").mapInArrow(bound, f"d {kind}, u long, item {ikind}, words array<long>, at array<int>")
    # a document's candidates go in lots of 64 with its text
    lot = F.floor((F.row_number().over(Window.partitionBy("d").orderBy("u")) - 1) / 64)
    lots = materialize(some.withColumn("lot", lot).groupBy("d", "lot").agg(F.collect_list(F.struct("item", "words", "at")).alias("c")))
    both = lookup_join(docs.select(F.col(doc_key).alias("d"), F.col(text).alias("t")).filter("t IS NOT NULL"), lots, ["d"], spread="t", width=F.lit(64) + F.aggregate("c", F.lit(0), lambda n, x: n + 32 + 8 * F.size(x["words"]) + 4 * F.size(x["at"])))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Folding()
        known: dict[bytes, Item] = {}
        for b in batches:
            every = [plain(t) for t in b.column("t").to_pylist()]
            for lo, hi in chunks(every):
                h, off = fold.words(every[lo:hi])
                h = h.view(np.int64)
                cases, whose = [], []
                for r in range(lo, hi):
                    doc, c = h[off[r - lo] : off[r - lo + 1]], b.column("c")[r].values
                    item_type = c.field("item").type
                    for i, (words, at) in enumerate(zip(c.field("words"), c.field("at"), strict=True)):
                        w, p = words.values.to_numpy(), np.unique(at.values.to_numpy())
                        if (item := known.get(w.tobytes())) is None:
                            known = known if len(known) < 10_000 else {}
                            item = known[w.tobytes()] = Item(w)
                        if item.can_hold(doc, p, share * len(w)):
                            cases.append((item, doc, p))
                            whose.append((r, c.field("item")[i].as_py()))
                rows = [(*k, n, len(c[0].words)) for k, n, c in zip(whose, most_held(cases, share), cases, strict=True) if n >= share * len(c[0].words)]
                if rows:
                    r, i, n, m = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column("d").take(pa.array(r)), pa.array(i, item_type), pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=[doc_key, item_key, "held", "words"])

    out = both.select("d", "t", "c").mapInArrow(verify, f"`{doc_key}` {kind}, `{item_key}` {ikind}, held long, words long")
    return out.groupBy(doc_key, item_key).agg(F.max(F.struct("held", "words")).alias("m")).select(doc_key, item_key, "m.held", "m.words")
