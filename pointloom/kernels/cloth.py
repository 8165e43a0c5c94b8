"""The elastic cloth: Verlet steps, one ordered sweep of constraints, collision and pinning.

The sweep corrects particles one after another, so a correction sees those before it. Two
particles more than four cells apart touch nothing in common; hence all particles with equal
column + 5 row can be corrected at once, as arrays, with the same result as one by one.
"""

from __future__ import annotations

from collections import deque

import numpy as np

# How far a particle moves in one sweep, by rigidness, beside a pinned one and beside a free one.
BESIDE_PINNED = [0, 0.3, 0.51, 0.657, 0.7599, 0.83193, 0.88235, 0.91765, 0.94235, 0.95965, 0.97175, 0.98023, 0.98616, 0.99031, 0.99322]
BESIDE_FREE = [0, 0.3, 0.42, 0.468, 0.4872, 0.4949, 0.498, 0.4992, 0.4997, 0.4999, 0.4999, 0.5, 0.5, 0.5, 0.5]
DAMPING, GRAVITY, LIFT, BUFFER, STILL, SLOPE, PATCH = 0.01, 0.2, 0.05, 2, 0.005, 0.3, 100


def links(rows: int, cols: int) -> np.ndarray:
    """Neighbours of each particle in the order in which its springs are strung; -1 where there are no more.

    Springs are strung column by column: to the right, downwards, both diagonals, then the
    same at a distance of two.
    """
    c, r = np.meshgrid(np.arange(cols), np.arange(rows), indexing="ij")
    c, r = c.reshape(-1), r.reshape(-1)
    at = np.arange(len(c))
    ends, order = [], []
    kind = 0
    for s in (1, 2):
        for (ar, ac), (br, bc), fits in (
            ((0, 0), (0, s), c < cols - s),
            ((0, 0), (s, 0), r < rows - s),
            ((0, 0), (s, s), (c < cols - s) & (r < rows - s)),
            ((0, s), (s, 0), (c < cols - s) & (r < rows - s)),
        ):
            a, b = (r + ar) * cols + c + ac, (r + br) * cols + c + bc
            ends.append(np.stack([a[fits], b[fits]], axis=1))
            order.append(at[fits] * 8 + kind)
            kind += 1
    ends, order = np.concatenate(ends), np.concatenate(order)
    ends = ends[np.argsort(order)]
    src, dst = np.concatenate([ends, ends[:, ::-1]], axis=1).reshape(-1, 2).T
    by = np.argsort(src, kind="stable")
    src, dst = src[by], dst[by]
    first = np.searchsorted(src, np.arange(rows * cols))
    out = np.full((rows * cols, 16), -1, dtype=np.int32)
    out[src, np.arange(len(src)) - first[src]] = dst
    return out


def fill(heights: np.ndarray, springs: np.ndarray) -> np.ndarray:
    """NaN cells take the first known one to the right, left, above, below, else the first that springs lead to."""
    out = heights.copy()

    def carried(z: np.ndarray, axis: int, back: bool) -> np.ndarray:
        """For each cell the nearest known one before it along the axis (after it, if back)."""
        z = np.flip(z, axis) if back else z
        known = ~np.isnan(z)
        index = np.arange(z.shape[axis]).reshape([-1, 1] if axis == 0 else [1, -1])
        last = np.maximum.accumulate(np.where(known, index, -1), axis=axis)
        got = np.where(last >= 0, np.take_along_axis(z, np.maximum(last, 0), axis), np.nan)
        return np.flip(got, axis) if back else got

    for axis, back in ((1, True), (1, False), (0, False), (0, True)):
        out = np.where(np.isnan(out), carried(heights, axis, back), out)
    flat, known = out.reshape(-1), heights.reshape(-1)
    for k in np.flatnonzero(np.isnan(flat)):
        seen, queue = {int(k)}, deque([int(k)])
        while queue:
            p = queue.popleft()
            if not np.isnan(known[p]):
                flat[k] = known[p]
                break
            for q in springs[p][springs[p] >= 0].tolist():
                if q not in seen:
                    seen.add(q)
                    queue.append(q)
    return flat.reshape(heights.shape)


def simulate(heights: np.ndarray, start: float, rigidness: int = 2, iterations: int = 500, step: float = 0.65, smooth: bool = False) -> np.ndarray:
    """Particle heights (rows, cols) after the cloth came to rest on heights (NaN: no point there)."""
    rows, cols = heights.shape
    n = rows * cols
    springs = links(rows, cols)
    floor = fill(heights, springs).reshape(-1)
    stiff = min(max(rigidness, 0), 15)
    beside_pinned, beside_free = (1.0, 0.5) if stiff > 14 else (BESIDE_PINNED[stiff], BESIDE_FREE[stiff])
    r, c = np.divmod(np.arange(n), cols)
    wave = c + 5 * r
    by = np.argsort(wave, kind="stable")
    fronts = np.split(by, np.flatnonzero(np.diff(wave[by])) + 1)
    now, old = np.full(n, float(start)), np.full(n, float(start))
    free = np.ones(n, dtype=bool)
    push = -GRAVITY * step * step
    for _ in range(max(iterations, 0)):
        moved = now + (now - old) * (1 - DAMPING) + push
        old = np.where(free, now, old)
        now = np.where(free, moved, now)
        for front in fronts:
            own_free = free[front]
            for k in range(16):
                other = springs[front, k]
                there = other >= 0
                if not there.any():
                    break
                p, q, pf = front[there], other[there], own_free[there]
                qf = free[q]
                gap = now[q] - now[p]
                now[p] += np.where(pf, np.where(qf, gap * beside_free, gap * beside_pinned), 0.0)
                now[q] -= np.where(qf, np.where(pf, gap * beside_free, gap * beside_pinned), 0.0)
        most = float(np.abs(old - now)[free].max(initial=0.0))
        low = now < floor
        now = np.where(low, floor, now)
        free &= ~low
        if 0 < most < STILL:
            break
    if smooth:
        _settle_slopes(now.reshape(rows, cols), floor.reshape(rows, cols), free.reshape(rows, cols))
    return now.reshape(rows, cols)


def _shifts(z: np.ndarray, empty):
    """z moved by one cell in each of the four directions."""
    for axis in (0, 1):
        for d in (1, -1):
            out = np.roll(z, d, axis)
            edge = 0 if d == 1 else -1
            if axis == 0:
                out[edge] = empty
            else:
                out[:, edge] = empty
            yield out


def _settle_slopes(z: np.ndarray, floor: np.ndarray, free: np.ndarray) -> None:
    """Hanging patches of more than PATCH particles come down where the ground beside pinned ones is about level."""
    label = np.where(free, np.arange(free.size).reshape(free.shape), -1)
    while True:  # the largest number in each patch
        best = label
        for s in _shifts(label, -1):
            best = np.where(free, np.maximum(best, s), -1)
        if (best == label).all():
            break
        label = best
    names, counts = np.unique(label[free], return_counts=True)
    large = free & np.isin(label, names[counts > PATCH])
    down = np.zeros_like(free)
    around = list(_shifts(floor, np.inf))
    level = [np.abs(floor - a) < SLOPE for a in around]
    while True:
        new = large & ~down & np.any([lv & (s | p) for lv, s, p in zip(level, _shifts(~free, False), _shifts(down, False), strict=True)], axis=0)
        if not new.any():
            break
        down |= new
    z[down] = floor[down]
    free[down] = False
