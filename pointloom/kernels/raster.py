"""Raster kernels: hole filling and the liquid cloth."""

from __future__ import annotations

from collections import deque

import numpy as np


def fill_holes(z: np.ndarray) -> np.ndarray:
    """Fill NaN cells from known ones, breadth first in row order.

    A cell gets the mean of the neighbours (above, left, right, below) that are known when
    it is reached; values are kept as float32.
    """
    rows, cols = z.shape
    out = z.astype(np.float32).copy()
    known = ~np.isnan(out)
    queue = deque(map(tuple, np.argwhere(known)))
    if len(queue) == rows * cols:
        return out
    beside = lambda r, c: ((r + a, c + b) for a, b in ((-1, 0), (0, -1), (0, 1), (1, 0)) if 0 <= r + a < rows and 0 <= c + b < cols)
    while queue:
        for spot in beside(*queue.popleft()):
            if not known[spot]:
                near = [float(out[s]) for s in beside(*spot) if known[s]]
                out[spot] = np.float32(sum(near) / len(near))
                known[spot] = True
                queue.append(spot)
    return out


def settle_cloth(support: np.ndarray, top: float, resolution: float, rigidness: int = 2, iterations: int = 500, step: float = 0.65, eps: float = 1e-3) -> np.ndarray:
    """Heights of a cloth that falls on its support (-inf where there is none).

    A round lowers the cloth, lifts it to the support, and draws inner particles towards the
    mean of their four neighbours. It ends after three rounds in a row in which no particle
    moved, between lifted states, by max(eps, 0.15 resolution).
    """
    z = np.full(support.shape, float(top))
    before, calm = z.copy(), 0
    pull = rigidness / 3.0 * 0.5
    for _ in range(iterations):
        z = np.maximum(z - step * 0.65, support)
        moved = float(np.abs(z - before).max(initial=0.0))
        before = z
        new = z.copy()
        mean = (z[:-2, 1:-1] + z[2:, 1:-1] + z[1:-1, :-2] + z[1:-1, 2:]) * 0.25
        new[1:-1, 1:-1] = z[1:-1, 1:-1] + (mean - z[1:-1, 1:-1]) * pull
        z = new
        calm = calm + 1 if moved < max(eps, resolution * 0.15) else 0
        if calm >= 3:
            break
    return z
