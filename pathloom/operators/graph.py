"""Small graph and matrix kernels in numpy, used inside grouped functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from ..functions.geo import EARTH_M, np_haversine_m


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's connected component, by hooking roots and doubling pointers."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return root


def near_pairs(lon: np.ndarray, lat: np.ndarray, radius_m: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of positions at most ``radius_m`` apart, by neighbouring cells; no matrix of all distances."""
    if len(lat) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.degrees(radius_m / EARTH_M) * 1.000001
    wide = size / max(0.01, float(np.cos(np.radians(min(89.0, np.abs(lat).max() + size)))))
    cx, cy = np.floor((lon - lon.min()) / wide).astype(np.int64), np.floor((lat - lat.min()) / size).astype(np.int64)
    row = int(cx.max()) + 3
    key = cy * row + cx
    order = np.argsort(key, kind="stable")
    ks = key[order]
    left, right = [], []
    for step in (0, 1, row - 1, row, row + 1):
        lo = np.searchsorted(ks, ks + step, side="left") if step else np.arange(1, len(ks) + 1)
        hi = np.searchsorted(ks, ks + step, side="right")
        n = np.maximum(hi - lo, 0)
        i = np.repeat(np.arange(len(ks)), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        i, j = order[i], order[j]
        ok = np_haversine_m(lon[i], lat[i], lon[j], lat[j]) <= radius_m
        left.append(i[ok])
        right.append(j[ok])
    i, j = np.concatenate(left), np.concatenate(right)
    return np.minimum(i, j), np.maximum(i, j)


class _Cells:
    """Positions sorted into cells so small that every two of a cell lie within ``eps_m``, and pairs of cells in reach."""

    def __init__(self, lon: np.ndarray, lat: np.ndarray, eps_m: float) -> None:
        step = np.degrees(eps_m / np.sqrt(2) / EARTH_M) * 0.999
        wide = step / max(1e-3, float(np.cos(np.radians(np.abs(lat).min()))))
        cx, cy = np.floor((lon - lon.min()) / wide).astype(np.int64), np.floor((lat - lat.min()) / step).astype(np.int64)
        key = cy * (int(cx.max()) + 1) + cx
        self.order = np.argsort(key, kind="stable")
        ks = key[self.order]
        self.start = np.flatnonzero(np.r_[True, ks[1:] != ks[:-1]])
        self.end = np.r_[self.start[1:], len(ks)]
        self.of = np.empty(len(ks), np.int64)
        self.of[self.order] = np.repeat(np.arange(len(self.start)), self.end - self.start)
        lo, la = lon[self.order], lat[self.order]
        x0, x1, y0, y1 = (f.reduceat(v, self.start) for v in (lo, la) for f in (np.minimum, np.maximum))
        a, b = near_pairs((x0 + x1) / 2, (y0 + y1) / 2, 2.5 * eps_m)
        # bounds of the distance between two cells' positions, by their boxes
        cos = np.cos(np.radians(np.stack([y0, y1])))
        gap = lambda p0, p1: np.maximum(0, np.maximum(p0[b] - p1[a], p0[a] - p1[b]))
        far = lambda p0, p1: np.maximum(p1[b] - p0[a], p1[a] - p0[b])
        unit = np.radians(1) * EARTH_M
        least = np.hypot(gap(x0, x1) * np.minimum(cos.min(0)[a], cos.min(0)[b]), gap(y0, y1)) * unit * 0.999
        most = np.hypot(far(x0, x1) * np.maximum(cos.max(0)[a], cos.max(0)[b]), far(y0, y1)) * unit * 1.001
        keep = least <= eps_m
        self.a, self.b, self.sure = a[keep], b[keep], (most <= eps_m)[keep]

    def members(self, cell: int) -> np.ndarray:
        return self.order[self.start[cell] : self.end[cell]]


def _dbscan_cells(lon: np.ndarray, lat: np.ndarray, weight: np.ndarray, eps_m: float, min_pts: int) -> tuple[np.ndarray, np.ndarray, Callable]:
    """(core, component of cores, link): as by all pairs, but pairs are formed only where cells leave a question open."""
    k, c = len(lon), _Cells(lon, lat, eps_m)
    within = lambda i, j: np_haversine_m(lon[i][:, None], lat[i][:, None], lon[j], lat[j]) <= eps_m
    total = np.bincount(c.of, weights=weight).astype(np.int64)
    sure = total + np.bincount(c.a[c.sure], weights=total[c.b[c.sure]], minlength=len(total)).astype(np.int64) + np.bincount(c.b[c.sure], weights=total[c.a[c.sure]], minlength=len(total)).astype(np.int64)
    count = sure[c.of]
    open_pairs = list(zip(c.a[~c.sure].tolist(), c.b[~c.sure].tolist(), strict=True))
    for a, b in open_pairs:
        for x, y in ((a, b), (b, a)):
            i = c.members(x)
            i = i[count[i] < min_pts]
            if len(i):
                j = c.members(y)
                count[i] += within(i, j) @ weight[j]
    core = count >= min_pts
    # cores of a cell are one; of two cells if any two of their cores are
    lead = np.full(len(total), k)
    np.minimum.at(lead, c.of[core], np.flatnonzero(core))
    some = lead < k
    left, right = [np.flatnonzero(core)], [lead[c.of[core]]]
    both = c.sure & some[c.a] & some[c.b]
    left.append(lead[c.a[both]])
    right.append(lead[c.b[both]])
    for a, b in open_pairs:
        if some[a] and some[b]:
            i, j = c.members(a), c.members(b)
            i, j = i[core[i]], j[core[j]]
            if any(within(i[s : s + 256], j).any() for s in range(0, len(i), 256)):
                left.append(lead[[a]])
                right.append(lead[[b]])
    comp = components(k, np.concatenate(left), np.concatenate(right))

    def link(label: np.ndarray) -> None:
        """Border positions take the lowest label of a core in reach."""
        low = np.full(len(total), np.iinfo(np.int64).max)
        np.minimum.at(low, c.of[core], label[core])
        best = low.copy()
        np.minimum.at(best, c.a[c.sure], low[c.b[c.sure]])
        np.minimum.at(best, c.b[c.sure], low[c.a[c.sure]])
        border = ~core
        label[border] = np.minimum(label[border], best[c.of[border]])
        for a, b in open_pairs:
            for x, y in ((a, b), (b, a)):
                if some[y]:
                    i = c.members(x)
                    i = i[border[i]]
                    if len(i):
                        j = c.members(y)
                        j = j[core[j]]
                        label[i] = np.minimum(label[i], np.where(within(i, j), label[j], np.iinfo(np.int64).max).min(1))

    return core, comp, link


def _dbscan_pairs(lon: np.ndarray, lat: np.ndarray, weight: np.ndarray, eps_m: float, min_pts: int) -> tuple[np.ndarray, np.ndarray, Callable]:
    """The same by all pairs in reach."""
    k = len(lon)
    i, j = near_pairs(lon, lat, eps_m)
    count = weight + np.bincount(i, weights=weight[j], minlength=k) + np.bincount(j, weights=weight[i], minlength=k)
    core = count >= min_pts
    both = core[i] & core[j]

    def link(label: np.ndarray) -> None:
        for a, b in ((i, j), (j, i)):
            edge = core[a] & ~core[b]
            np.minimum.at(label, b[edge], label[a[edge]])

    return core, components(k, i[both], j[both]), link


#: Up to so many positions pairs in reach are formed at once; beyond it cells decide most of them.
PAIRED = 2_000


def dbscan(lon: np.ndarray, lat: np.ndarray, eps_m: float, min_pts: int) -> np.ndarray:
    """Cluster of each position, 0 for noise. ``eps_m`` is inclusive, ``min_pts`` counts the position itself.

    Clusters are numbered from 1 in the order of their first core position; a border position goes to the lowest-numbered
    cluster with a core within reach. Equal positions are told apart only by their number. Memory and, but for positions
    on the rim of dense cells, time grow with the number of positions, not of pairs.
    """
    n = len(lat)
    if not n:
        return np.zeros(0, np.int64)
    spots, at = np.unique(np.stack([lon, lat], 1), axis=0, return_inverse=True)
    at = at.ravel()
    k = len(spots)
    how = _dbscan_pairs if k <= PAIRED else _dbscan_cells
    core, comp, link = how(spots[:, 0], spots[:, 1], np.bincount(at, minlength=k), eps_m, min_pts)
    first = np.full(k, n)  # first row of each position
    np.minimum.at(first, at, np.arange(n))
    lead = np.full(k, n)
    np.minimum.at(lead, comp[core], first[core])
    starts = np.unique(lead[lead < n])
    label = np.full(k, len(starts) + 1)
    label[core] = np.searchsorted(starts, lead[comp[core]]) + 1
    link(label)
    label[label == len(starts) + 1] = 0
    return label[at]


def distance_matrix(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    return np_haversine_m(lon[:, None], lat[:, None], lon[None, :], lat[None, :])


class _Medoids:
    """Medoids under symmetric distances, and what each swap would cost: ``near_sum[h]`` is the total distance if h were added, ``lost[x, h]`` what
    it grows by if medoid x also goes. A swap changes the nearest two medoids of few items, so only their rows are
    taken out of the sums and put in again.
    """

    def __init__(self, d: np.ndarray, w: np.ndarray, most: int) -> None:
        n = len(d)
        self.d, self.w, self.medoids = d, w, []
        self.own, self.first, self.second = np.full(n, -1), np.full(n, np.inf), np.full(n, np.inf)
        self.near_sum, self.lost = np.zeros(n), np.zeros((most, n))

    def copy(self) -> _Medoids:
        c = _Medoids.__new__(_Medoids)
        c.d, c.w, c.medoids, c.own, c.first, c.second, c.near_sum, c.lost = self.d, self.w, self.medoids.copy(), self.own.copy(), self.first.copy(), self.second.copy(), self.near_sum.copy(), self.lost.copy()
        return c

    def total(self) -> float:
        return float((self.w * self.first).sum())

    def _count(self, rows: np.ndarray, sign: float, block: int = 128) -> None:
        rows = rows[np.argsort(self.own[rows], kind="stable")]  # those of a medoid follow each other
        space = np.empty((2, min(block, len(rows)), len(self.d)))
        for s in range(0, len(rows), block):
            r = rows[s : s + block]
            least, more = space[:, : len(r)]
            weight, own = sign * self.w[r], self.own[r]
            np.take(self.d, r, axis=0, out=more, mode="clip")
            np.minimum(more, self.first[r][:, None], out=least)
            np.minimum(more, self.second[r][:, None], out=more)
            more -= least
            self.near_sum += weight @ least
            at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]).tolist()
            for a, b in zip(at, [*at[1:], len(r)], strict=True):
                self.lost[own[a]] += weight[a:b] @ more[a:b]

    def settle(self) -> None:
        """Nearest two medoids anew, and the sums for the items for which they changed."""
        md = self.d[self.medoids]
        every = np.arange(md.shape[1])
        own = md.argmin(0)
        first = md[own, every]
        md[own, every] = np.inf
        second = md.min(0)
        rows = np.flatnonzero((own != self.own) | (first != self.first) | (second != self.second))
        old = rows[self.own[rows] >= 0]
        if 2 * len(old) < len(every):
            self._count(old, -1.0)
        else:
            self.near_sum[:], self.lost[:], rows = 0, 0, every
        self.own, self.first, self.second = own, first, second
        self._count(rows, 1.0)


def pams(d: np.ndarray, k_from: int, k_to: int, w: np.ndarray) -> Iterator[np.ndarray]:
    """Medoid index of each item under weights, for each number of medoids: greedy build, then the best swap until none
    gains. Ties, and differences that rounding can make: lowest index. What is built for k medoids is the start for
    k + 1."""
    n = len(d)
    built = _Medoids(d, w, max(1, min(k_to, n)))

    alone = w @ d
    slack = 1e-9 + 1e-14 * float(alone.max())

    def least(cost: np.ndarray) -> int:
        return int((cost <= cost.min() + slack).argmax())

    for k in range(1, k_to + 1):
        if k <= n:
            cost = built.near_sum.copy() if k > 1 else alone
            cost[built.medoids] = np.inf
            built.medoids.append(least(cost))
            built.settle()
        if k < k_from:
            continue
        at = built.copy()
        while True:
            now = at.total()
            change = at.near_sum + at.lost[: len(at.medoids)] - now
            change[:, at.medoids] = np.inf
            x, h = divmod(least(change), n)
            if not change[x, h] < -slack:
                break
            gone, at.medoids[x] = at.medoids[x], h
            at.settle()
            if not at.total() < now:  # a gain of rounding only
                at.medoids[x] = gone
                break
        medoids = sorted(at.medoids)
        yield np.array(medoids)[np.argmin(d[:, medoids], axis=1)]


def pam(d: np.ndarray, k: int, w: np.ndarray) -> np.ndarray:
    """The same for one number of medoids."""
    return next(pams(d, k, k, w))


def silhouette(d: np.ndarray, label: np.ndarray, w: np.ndarray) -> float:
    """Weighted mean silhouette width by a distance matrix; items alone in their cluster count 0. NaN with fewer than two
    clusters."""
    return _silhouette(lambda rows: d[rows], label, w)


def silhouette_of(lon: np.ndarray, lat: np.ndarray, label: np.ndarray, w: np.ndarray) -> float:
    """The same of positions, a block of rows of the matrix at a time."""
    return _silhouette(lambda rows: np_haversine_m(lon[rows][:, None], lat[rows][:, None], lon, lat), label, w)


def _silhouette(distances: Callable[[slice], np.ndarray], label: np.ndarray, w: np.ndarray, block: int = 512) -> float:
    names, c = np.unique(label, return_inverse=True)
    if len(names) < 2:
        return float("nan")
    member = np.zeros((len(label), len(names)))
    member[np.arange(len(label)), c] = w
    size, total = member.sum(0), 0.0
    for s in range(0, len(label), block):
        rows = slice(s, s + block)
        cc = c[rows]
        sums, at = distances(rows) @ member, np.arange(len(cc))
        own = size[cc] - 1
        with np.errstate(invalid="ignore", divide="ignore"):
            a, other = sums[at, cc] / own, sums / size
            other[at, cc] = np.inf
            b = other.min(1)
            width = np.where(own > 0, (b - a) / np.maximum(a, b), 0.0)
        total += float((w[rows] * np.nan_to_num(width)).sum())
    return total / float(w.sum())


def match_pairs(edges: list[tuple[int, int]]) -> dict[int, int]:
    """A largest one-to-one matching (left -> right) by augmenting paths; edges are tried in their order."""
    ways: dict[int, list[int]] = {}
    for a, b in edges:
        ways.setdefault(a, []).append(b)
    owner: dict[int, int] = {}
    mate: dict[int, int] = {}
    for start in sorted(ways):
        # breadth-first search for a free right side, then the path's pairs are exchanged
        came: dict[int, int] = {}
        queue, free = [start], None
        for a in queue:
            for b in ways.get(a, ()):
                if b in came:
                    continue
                came[b] = a
                if b not in owner:
                    free = b
                    break
                queue.append(owner[b])
            if free is not None:
                break
        while free is not None:
            a = came[free]
            left_over = mate.get(a)
            owner[free], mate[a] = a, free
            free = left_over if a != start else None
    return mate
