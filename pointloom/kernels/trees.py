"""Individual trees: two piecewise-constant approximations on graphs, then crowns joined to stems."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

from .fits import Grid


@dataclass(frozen=True)
class TreeParams:
    cell1: float = 0.05
    near1: int = 5
    strength1: float = 1.0
    cell2: float = 0.1
    near2: int = 10
    gap: float = 2.0
    strength2: float = 10.0
    near3: int = 10
    lift: float = 0.5
    vertical: float = 0.5


def _undirected(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray):
    """Each pair once with the sum of its weights; no loops."""
    ok = u != v
    key, place = np.unique(np.minimum(u, v)[ok].astype(np.int64) * n + np.maximum(u, v)[ok], return_inverse=True)
    return key // n, key % n, np.bincount(place, w[ok], len(key))


def _two_means(y: np.ndarray) -> np.ndarray:
    """Two centres: the point farthest from the mean and the one farthest from it, then two rounds of means."""
    a = y[((y - y.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    b = y[((y - a) ** 2).sum(axis=1).argmax()]
    c = np.stack([a, b])
    for _ in range(2):
        side = ((y - c[1]) ** 2).sum(axis=1) < ((y - c[0]) ** 2).sum(axis=1)
        if side.all() or not side.any():
            break
        c = np.stack([y[~side].mean(axis=0), y[side].mean(axis=0)])
    return c


def _halves(y: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray | None:
    """A split of one component that lowers data plus cut; None if none was found."""
    whole = ((y - y.mean(axis=0)) ** 2).sum()
    c = _two_means(y)
    side = ((y - c[1]) ** 2).sum(axis=1) < ((y - c[0]) ** 2).sum(axis=1)
    turn = np.arange(len(y)) % 2 == 0
    for k in range(4):
        pull = ((y - c[0]) ** 2).sum(axis=1) - ((y - c[1]) ** 2).sum(axis=1)
        for _ in range(40):
            before = side.copy()
            for part in (turn, ~turn):  # neighbours rarely change together
                s = np.where(side, 1.0, -1.0)
                push = np.bincount(u, w * s[v], len(y)) + np.bincount(v, w * s[u], len(y))
                side = np.where(part, pull + push > 0, side)
            if (side == before).all():
                break
        if side.all() or not side.any():
            return None
        if k < 3:
            c = np.stack([y[~side].mean(axis=0), y[side].mean(axis=0)])
    parts = sum(((y[m] - y[m].mean(axis=0)) ** 2).sum() for m in (side, ~side))
    return side if parts + w[side[u] != side[v]].sum() < whole else None


def _merged(comp: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Merge components while the cut that goes is worth more than the data it costs; the best gain first."""
    while True:
        names, comp = np.unique(comp, return_inverse=True)
        k = len(names)
        size = np.bincount(comp, minlength=k).astype(float)
        mean = np.stack([np.bincount(comp, y[:, d], k) for d in range(y.shape[1])], axis=1) / size[:, None]
        a, b, c = _undirected(k, comp[u], comp[v], w)
        gain = c - size[a] * size[b] / (size[a] + size[b]) * ((mean[a] - mean[b]) ** 2).sum(axis=1)
        heap = [(-g, i, j, x) for g, i, j, x in zip(gain.tolist(), a.tolist(), b.tolist(), c.tolist(), strict=True) if g > 0]
        if not heap:
            return comp
        heapq.heapify(heap)
        root = list(range(k))

        def find(x: int, root: list = root) -> int:
            while root[x] != x:
                x = root[x]
            return x

        moved = False
        while heap:
            _, i, j, x = heapq.heappop(heap)
            i, j = find(i), find(j)
            if i != j and x - size[i] * size[j] / (size[i] + size[j]) * ((mean[i] - mean[j]) ** 2).sum() > 0:
                i, j = min(i, j), max(i, j)
                mean[i] = (mean[i] * size[i] + mean[j] * size[j]) / (size[i] + size[j])
                size[i] += size[j]
                root[j] = i
                moved = True
        comp = np.array([find(x) for x in range(k)])[comp]
        if not moved:
            return comp


def cut_pursuit(y: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Components of a piecewise-constant approximation of y: squared error plus the weight of cut edges."""
    u, v, w = _undirected(len(y), u, v, w)
    comp, settled = np.zeros(len(y), dtype=np.int64), set()
    for _ in range(rounds):
        changed = False
        order = np.argsort(comp, kind="stable")
        names, first = np.unique(comp[order], return_index=True)
        inner = comp[u] == comp[v]
        by = np.argsort(comp[u][inner], kind="stable")
        eu, ev, ew = u[inner][by], v[inner][by], w[inner][by]
        cuts = np.searchsorted(comp[eu], np.append(names, names[-1] + 1))
        local, fresh = np.empty(len(y), dtype=np.int64), int(comp.max()) + 1
        new = comp.copy()
        for k, own in enumerate(np.split(order, first[1:])):
            key = (len(own), int(own[0]), int(own[-1]))
            if len(own) < 2 or key in settled:
                continue
            local[own] = np.arange(len(own))
            e = slice(cuts[k], cuts[k + 1])
            side = _halves(y[own], local[eu[e]], local[ev[e]], ew[e])
            if side is None:
                settled.add(key)
            else:
                new[own[side]] = fresh
                fresh += 1
                changed = True
        after = _merged(new, y, u, v, w)
        same = len(np.unique(after * (int(comp.max()) + 1) + comp)) == len(np.unique(comp)) == len(np.unique(after))
        comp = after
        if not changed or same:
            break
    return comp


def _cells(p: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """The first point of each cell, and the cell of each point in that order."""
    key = np.floor((p - p.min(axis=0)) / size).astype(np.int64)
    _, first, place = np.unique(key, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    rank = np.empty(len(first), dtype=np.int64)
    rank[order] = np.arange(len(first))
    return first[order], rank[place.reshape(-1)]


def _edges(p: np.ndarray, k: int):
    where, d2 = Grid(p).nearest(p, k)
    u = np.repeat(np.arange(len(p)), where.shape[1])
    ok = where.reshape(-1) != u
    return u[ok], where.reshape(-1)[ok], d2.reshape(-1)[ok]


def first_stage(p: np.ndarray, t: TreeParams) -> np.ndarray:
    """Small segments: nearby points pull together the more the nearer they are."""
    rep, cell = _cells(p, t.cell1)
    if len(rep) < 2:
        return np.zeros(len(p), dtype=np.int64)
    u, v, d2 = _edges(p[rep], max(t.near1, 1))
    d = np.sqrt(d2) + 1e-6
    return cut_pursuit(p[rep], u, v, np.exp(-d * d) * t.strength1)[cell]


def second_stage(p: np.ndarray, seg: np.ndarray, t: TreeParams) -> np.ndarray:
    """Segments in plan: an edge between two near segments weighs more the smaller their (squared) gap is."""
    names, seg = np.unique(seg, return_inverse=True)
    n = len(names)
    mean = np.stack([np.bincount(seg, p[:, k], n) for k in range(3)], axis=1) / np.bincount(seg)[:, None]
    spots, of, back = [], [], np.empty(len(p), dtype=np.int64)
    at = 0
    for k in range(n):
        own = np.flatnonzero(seg == k)
        rep, cell = _cells(p[own], t.cell2)
        spots.append(own[rep])
        of.append(np.full(len(rep), k))
        back[own] = cell + at
        at += len(rep)
    spots, of = np.concatenate(spots), np.concatenate(of)
    if n < 2:
        return np.zeros(len(p), dtype=np.int64)
    near, _ = Grid(mean).nearest(mean, min(max(t.near2, 1), n))
    q = p[spots]
    u, v, _ = _edges(q, max(t.near2, 1))
    ok = (of[u] != of[v]) & (near[of[u]] == of[v][:, None]).any(axis=1)
    u, v = u[ok], v[ok]
    gaps: dict[tuple[int, int], float] = {}
    for a, b in np.unique(np.stack([of[u], of[v]], axis=1), axis=0).tolist():
        gaps[a, b] = float(Grid(q[of == a]).nearest(q[of == b])[1].min())
    gap = np.array([gaps[a, b] for a, b in zip(of[u].tolist(), of[v].tolist(), strict=True)])
    ok = gap < t.gap
    return cut_pursuit(q[:, :2], u[ok], v[ok], 10 / ((gap[ok] + 0.001) / 0.01) * t.strength2)[back]


def _overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smaller of two boxes (x0, y0, x1, y1) that both cover."""
    x, y = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    least = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    return max(x, 0) * max(y, 0) / least if least > 0 else 0.0


def third_stage(p: np.ndarray, seg: np.ndarray, group: np.ndarray, t: TreeParams) -> np.ndarray:
    """Groups that hang above their neighbours join the stem that fits them best; labels 1..K."""
    names, seg = np.unique(seg, return_inverse=True)
    n = len(names)
    votes = np.unique(np.stack([seg, group], axis=1), axis=0, return_counts=True)
    pick = np.lexsort((votes[0][:, 1], -votes[1], votes[0][:, 0]))
    lead = pick[np.unique(votes[0][pick, 0], return_index=True)[1]]
    value = votes[0][lead, 1]
    mean = np.stack([np.bincount(seg, p[:, k], n) for k in range(3)], axis=1) / np.bincount(seg)[:, None]
    before, rounds = None, 0
    while True:
        uniq, g = np.unique(value, return_inverse=True)
        k = len(uniq)
        if k < 2:
            break
        rounds += 1
        of = g[seg]
        low, high = np.full((k, 3), np.inf), np.full((k, 3), -np.inf)
        np.minimum.at(low, of, p)
        np.maximum.at(high, of, p)
        center = np.stack([np.bincount(of, p[:, d], k) for d in range(2)], axis=1) / np.bincount(of)[:, None]
        height = high[:, 2] - low[:, 2]
        flat = np.concatenate([center, np.zeros((k, 1))], axis=1)
        near, d2 = Grid(flat).nearest(flat, min(max(t.near3, 2), k))
        sigma = d2[:, 1].mean()
        floor = np.minimum(low[near, 2].min(axis=1), low[:, 2])
        lifted = np.abs(np.divide(low[:, 2] - floor, height, out=np.zeros(k), where=height > 0)) > t.lift
        ratio = height / max(np.median(height), 1e-12)
        take = lifted & (ratio > 1.5) if rounds == 1 else lifted
        if rounds == 1 and lifted.any() and not take.any():
            take = np.arange(k) == np.flatnonzero(lifted)[ratio[lifted].argmax()]
        stay = np.flatnonzero(~take)
        if not take.any() or not len(stay) or take.sum() == before:
            break
        before = int(take.sum())
        parts = [np.flatnonzero(g == j) for j in range(k)]
        box = np.concatenate([low[:, :2], high[:, :2]], axis=1)
        beside, _ = Grid(flat[stay]).nearest(flat[take], min(max(t.near3, 1), len(stay)))
        new = value.copy()
        for own, found in zip(np.flatnonzero(take).tolist(), beside, strict=True):
            told = []
            for r in stay[found].tolist():
                s1, s2 = high[r, 2] - low[own, 2], high[own, 2] - low[r, 2]
                both = max(min(s1, s2) / max(s1, s2), 0.0) if max(s1, s2) > 0 else 0.0
                d3 = float(Grid(mean[parts[r]]).nearest(mean[parts[own]])[1].min())
                d2_ = float(np.hypot(*(mean[parts[r], :2].mean(axis=0) - mean[parts[own], :2].mean(axis=0))))
                far = min(d3, d2_) / sigma if sigma > 0 else 0.0
                told.append((np.exp(-((1 - _overlap(box[own], box[r])) ** 2) - t.vertical * (1 - both) ** 2 - far * far), r, d3))
            top = max(s for s, _, _ in told)
            if top > 0:
                alike = [(d3, -s, r) for s, r, d3 in told if s / top > 0.7]
                new[parts[own]] = uniq[min(alike)[2]]
        value = new
    return np.unique(value[seg], return_inverse=True)[1] + 1


def isolate(p: np.ndarray, t: TreeParams = TreeParams()) -> np.ndarray:  # noqa: B008
    """Tree labels 1..K of the points of one cloud without ground."""
    if not len(p):
        return np.zeros(0, dtype=np.int64)
    p = (p - p.mean(axis=0)).astype(np.float32).astype(float)
    seg = first_stage(p, t)
    return third_stage(p, seg, second_stage(p, seg, t), t)
