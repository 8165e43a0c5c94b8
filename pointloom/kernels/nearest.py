"""Nearest points: a tree that splits space by a sample, distances of boxes, exact searches in blocks."""

from __future__ import annotations

import numpy as np

#: Distances that are held at once.
BLOCK = 1 << 20


def _cut(p: np.ndarray, least: int) -> tuple[int, float] | None:
    """An axis and a value that leave ``least`` points or more on both sides, or None: equal values stay together."""
    for axis in np.argsort(p.min(axis=0) - p.max(axis=0), kind="stable"):
        v = np.sort(p[:, axis])
        middle = v[len(v) // 2]
        for k in (np.searchsorted(v, middle), np.searchsorted(v, middle, "right")):
            if least <= k <= len(v) - least:
                return int(axis), float(v[k])
    return None


class Tree:
    """Parts of space with ``least`` points of the sample or more each, and ``most`` where they can be split so far."""

    def __init__(self, sample: np.ndarray, most: int, least: int):
        axis, value, child, self.leaves = [-1], [0.0], [0], 0
        todo = [(0, sample)]
        while todo:
            node, own = todo.pop()
            cut = _cut(own, least) if len(own) > max(most, 2 * least) else None
            if cut is None:
                child[node] = self.leaves
                self.leaves += 1
                continue
            axis[node], value[node], child[node] = *cut, len(axis)
            left = own[:, cut[0]] < cut[1]
            for part in (own[left], own[~left]):
                todo.append((len(axis), part))
                axis.append(-1)
                value.append(0.0)
                child.append(0)
        self.axis, self.value, self.child = np.array(axis), np.array(value), np.array(child)

    def leaf(self, p: np.ndarray) -> np.ndarray:
        """The part that each point lies in."""
        node, rows = np.zeros(len(p), np.int64), np.arange(len(p))
        while len(rows):
            axis = self.axis[node[rows]]
            rows, axis = rows[axis >= 0], axis[axis >= 0]
            at = node[rows]
            node[rows] = self.child[at] + (p[rows, axis] >= self.value[at])
        return self.child[node]


def _first(row: np.ndarray, n: int) -> np.ndarray:
    """Each element's place among those of its row; rows ascend."""
    return np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]


def nearest(q: np.ndarray, own: np.ndarray, reach: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, d2) of the k nearest points within each query's squared reach, nearest first, ties to the earlier point.

    own: the place of the point that a query does not count, or -1.
    """
    found = []
    step = max(1, BLOCK // max(len(p), 1))
    for at in range(0, len(q), step):
        x = q[at : at + step]
        # Summed from left to right, as SQL does.
        d2 = np.square(x[:, 0, None] - p[:, 0])
        d2 += np.square(x[:, 1, None] - p[:, 1])
        d2 += np.square(x[:, 2, None] - p[:, 2])
        mine = np.flatnonzero(own[at : at + step] >= 0)
        d2[mine, own[at : at + step][mine]] = np.nan
        limit = reach[at : at + step]
        if len(p) > k:
            limit = np.fmin(limit, np.partition(d2, k - 1, axis=1)[:, k - 1])
        row, col = np.nonzero(d2 <= limit[:, None])
        d = d2[row, col]
        by = np.lexsort((col, d, row))
        row, col, d = row[by], col[by], d[by]
        kept = _first(row, len(x)) < k
        found.append((row[kept] + at, col[kept], d[kept]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def touched(q: np.ndarray, home: np.ndarray, reach: np.ndarray, low: np.ndarray, high: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, box) of the boxes within each query's squared reach but its home, nearest first, from place begin to end; and whether a query has more.

    A box's distance is summed as those of points are, and rounding is monotonic, so no
    point in the box is nearer, not even by the last bit.
    """
    rows, boxes, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(q), dtype=bool)
    square = lambda lo, hi: np.square(np.maximum(np.maximum(lo, hi), 0))
    step = max(1, BLOCK // len(low))
    for at in range(0, len(q), step):
        x, far = q[at : at + step], reach[at : at + step]
        a, b = x.min(axis=0), x.max(axis=0)
        near = np.flatnonzero(sum(square(low[:, n] - b[n], a[n] - high[:, n]) for n in range(3)) <= far.max())
        d2 = sum(square(low[near, n] - x[:, n, None], x[:, n, None] - high[near, n]) for n in range(3))
        row, col = np.nonzero((d2 <= far[:, None]) & (near != home[at : at + step, None]))
        by = np.lexsort((col, d2[row, col], row))
        row, col = row[by], col[by]
        place = _first(row, len(x))
        more[at : at + step] = np.bincount(row, minlength=len(x)) > end
        kept = (place >= begin) & (place < end)
        rows.append(row[kept] + at)
        boxes.append(near[col[kept]])
    return np.concatenate(rows), np.concatenate(boxes), more
