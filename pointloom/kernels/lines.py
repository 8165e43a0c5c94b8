"""Taking wires out of a connected set of points: azimuth votes, parabolas, lateral gaps."""

from __future__ import annotations

import math

import numpy as np

BINS, PEAKS, WINDOW, REFINE = 60, 3, 2, 5
TRIALS, SPAN, ROUNDS = 384, 0.35, 64
GAP, WIRE_RMS = 0.30, 0.35


def azimuths(direction: np.ndarray, linearity: np.ndarray) -> list[float]:
    """The strongest azimuths (radians, modulo pi), weighed by linearity and by how level a direction is."""
    level = np.hypot(direction[:, 0], direction[:, 1])
    ok = np.isfinite(level) & (level > 1e-6) & (linearity > 0)
    width = math.pi / BINS
    phi = np.mod(np.arctan2(direction[ok, 1], direction[ok, 0]), math.pi)
    votes = np.bincount(np.minimum((phi / width).astype(int), BINS - 1), linearity[ok] * level[ok], BINS)
    near = np.stack([np.roll(votes, k) for k in range(-WINDOW, WINDOW + 1)])
    found = []
    for b in np.flatnonzero((votes > 0) & (votes >= near.max(axis=0))):
        k = (np.arange(b - REFINE, b + REFINE + 1)) % BINS
        twice = 2 * (k + 0.5) * width
        found.append((-votes[k].sum(), math.atan2((votes[k] * np.sin(twice)).sum(), (votes[k] * np.cos(twice)).sum()) / 2 % math.pi))
    return [phi for _, phi in sorted(found)[:PEAKS]]


def _least_squares(s: np.ndarray, z: np.ndarray) -> np.ndarray | None:
    """a + b s + c s^2."""
    m, w = s.mean(), max(np.abs(s - s.mean()).max(), 1e-9)
    u = (s - m) / w
    v = np.stack([np.ones_like(u), u, u * u], axis=1)
    h = (v[:, :, None] * v[:, None]).sum(axis=0)
    if np.linalg.matrix_rank(h) < 3:
        return None
    a, b, c = np.linalg.solve(h, (v * z[:, None]).sum(axis=0))
    return np.array([a - b * m / w + c * m * m / w / w, b / w - 2 * c * m / w / w, c / w / w])


def _parabola(s: np.ndarray, z: np.ndarray, tolerance: float, least: int, rng) -> np.ndarray | None:
    """Indices of the points near the best parabola."""
    span = s.max() - s.min()
    if not span > 2.0:
        return None
    k = rng.integers(0, len(s), (TRIALS, 3))
    x, y = s[k], z[k]
    wide = x.max(axis=1) - x.min(axis=1) >= max(SPAN * span, 1.0)
    d = (x[:, 0] - x[:, 1]) * (x[:, 0] - x[:, 2]) * (x[:, 1] - x[:, 2])
    ok = wide & (np.abs(d) > 1e-9)
    x, y, d = x[ok], y[ok], d[ok]
    if not len(x):
        return None
    c = (x[:, 2] * (y[:, 1] - y[:, 0]) + x[:, 1] * (y[:, 0] - y[:, 2]) + x[:, 0] * (y[:, 2] - y[:, 1])) / d
    c = -c
    b = (y[:, 1] - y[:, 0]) / (x[:, 1] - x[:, 0] + (x[:, 1] == x[:, 0])) - c * (x[:, 0] + x[:, 1])
    a = y[:, 0] - b * x[:, 0] - c * x[:, 0] ** 2
    counts = [int((np.abs(z - (i + j * s + l * s * s)) <= tolerance).sum()) for i, j, l in zip(a, b, c, strict=True)]
    best = int(np.argmax(counts))
    model, inside = np.array([a[best], b[best], c[best]]), None
    for _ in range(2):
        inside = np.flatnonzero(np.abs(z - (model[0] + model[1] * s + model[2] * s * s)) <= tolerance)
        if len(inside) < least:
            return None
        better = _least_squares(s[inside], z[inside])
        if better is None:
            return None
        model = better
    return inside


def _apart(s: np.ndarray, t: np.ndarray, least: int) -> list[np.ndarray]:
    """Groups of points between lateral gaps that lie along a line each."""
    order = np.argsort(t, kind="stable")
    out = []
    for part in np.split(order, np.flatnonzero(np.diff(t[order]) > GAP) + 1):
        for last in (False, True):
            if len(part) < least:
                break
            u = s[part] - s[part].mean()
            spread = (u * u).sum()
            slope = (u * (t[part] - t[part].mean())).sum() / spread if spread > 0 else 0.0
            off = t[part] - t[part].mean() - slope * u
            rms = math.sqrt((off * off).mean())
            near = np.abs(off) <= max(3 * rms, GAP)
            if not last and near.sum() >= least:
                part = part[near]
                continue
            if rms <= WIRE_RMS:
                out.append(part)
            break
    return out


def strip(p: np.ndarray, direction: np.ndarray, linearity: np.ndarray, tolerance: float = 0.35, least: int = 20) -> list[tuple[np.ndarray, float]]:
    """(indices, azimuth) of the wires of a connected set; what fits a parabola leaves it, wire or not."""
    rng = np.random.default_rng(0x5DEECE66D)
    active, out = np.arange(len(p)), []
    for _ in range(ROUNDS):
        if len(active) < least:
            break
        own = p[active]
        mid = own[:, :2].mean(axis=0)
        best, turn = None, 0.0
        for phi in azimuths(direction[active], linearity[active]):
            s = (own[:, 0] - mid[0]) * math.cos(phi) + (own[:, 1] - mid[1]) * math.sin(phi)
            inside = _parabola(s, own[:, 2], tolerance, least, rng)
            if inside is not None and (best is None or len(inside) > len(best)):
                best, turn = inside, phi
        if best is None:
            break
        s = (own[best, 0] - mid[0]) * math.cos(turn) + (own[best, 1] - mid[1]) * math.sin(turn)
        t = (own[best, 1] - mid[1]) * math.cos(turn) - (own[best, 0] - mid[0]) * math.sin(turn)
        out += [(active[best[k]], turn) for k in _apart(s, t, least)]
        active = np.delete(active, best)
    return out
