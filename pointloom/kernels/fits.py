"""Model fits on bounded samples: planes, circles, cylinder axes, rigid transforms."""

from __future__ import annotations

import math

import numpy as np


def rounds_needed(share: float, draws: int, confidence: float) -> float:
    """How many draws find a clean one with the confidence, at a share of inliers."""
    good = share**draws
    if good >= 1:
        return 1
    return math.log(1 - confidence) / math.log(1 - good) if good > 0 else math.inf


def _search(n: int, draws: int, iterations: int, confidence: float, seed: int, make, count, block: int = 64):
    """The hypothesis with most inliers, the first of equals; None where none is sound."""
    rng = np.random.default_rng(seed)
    best, most, done = None, 0, 0
    while done < iterations and done < rounds_needed(most / n, draws, confidence):
        picks = rng.integers(0, n, size=(min(block, iterations - done), draws))
        models = make(picks)
        done += len(picks)
        if len(models):
            found = count(models)
            k = int(np.argmax(found))
            if found[k] > most:
                best, most = models[k], int(found[k])
    return best


def positive(n: np.ndarray) -> np.ndarray:
    """The sign for which the largest component is positive."""
    return -n if n[np.abs(n).argmax()] < 0 else n


def search_plane(p: np.ndarray, threshold: float, iterations: int, confidence: float, seed: int = 4711) -> np.ndarray | None:
    """(nx, ny, nz, d) by random triples."""
    if len(p) < 3 or iterations <= 0:
        return None

    def make(k):
        n = np.cross(p[k[:, 1]] - p[k[:, 0]], p[k[:, 2]] - p[k[:, 0]])
        size = np.sqrt((n * n).sum(axis=1))
        ok = size > 1e-12
        n = n[ok] / size[ok][:, None]
        return np.concatenate([n, -(n * p[k[ok, 0]]).sum(axis=1, keepdims=True)], axis=1)

    def count(models):
        return np.array([(np.abs(p[:, 0] * a + p[:, 1] * b + p[:, 2] * c + d) <= threshold).sum() for a, b, c, d in models])

    return _search(len(p), 3, iterations, confidence, seed, make, count)


def circles(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(cx, cy, r) through three points each; NaN where they are on a line."""
    d = 2 * ((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]))
    with np.errstate(divide="ignore", invalid="ignore"):
        u, v = ((b - a) ** 2).sum(axis=1), ((c - a) ** 2).sum(axis=1)
        x = (u * (c[:, 1] - a[:, 1]) - v * (b[:, 1] - a[:, 1])) / d
        y = (v * (b[:, 0] - a[:, 0]) - u * (c[:, 0] - a[:, 0])) / d
    out = np.stack([a[:, 0] + x, a[:, 1] + y, np.sqrt(x * x + y * y)], axis=1)
    out[np.abs(d) < 1e-12] = np.nan
    return out


def search_circle(p: np.ndarray, threshold: float, iterations: int, low: float = 0.0, high: float = 0.0, confidence: float = 0.99, seed: int = 4712) -> np.ndarray | None:
    """(cx, cy, r) by random triples; a limit of 0 is none."""
    if len(p) < 3 or iterations <= 0:
        return None

    def make(k):
        found = circles(p[k[:, 0]], p[k[:, 1]], p[k[:, 2]])
        r = found[:, 2]
        return found[np.isfinite(found).all(axis=1) & (r > 0) & (r >= low) & ((high <= 0) | (r <= high))]

    def count(models):
        return np.array([(np.abs(np.hypot(p[:, 0] - x, p[:, 1] - y) - r) <= threshold).sum() for x, y, r in models])

    return _search(len(p), 3, iterations, confidence, seed, make, count)


def kasa(p: np.ndarray) -> np.ndarray | None:
    """Algebraic least-squares circle."""
    if len(p) < 3:
        return None
    m = p.mean(axis=0)
    u, v = (p - m).T
    w = u * u + v * v
    uu, uv, vv = (u * u).sum(), (u * v).sum(), (v * v).sum()
    det = uu * vv - uv * uv
    if abs(det) <= 1e-12 * (uu + vv) ** 2:
        return None
    a, b = ((u * w).sum() * vv - (v * w).sum() * uv) / det / 2, ((v * w).sum() * uu - (u * w).sum() * uv) / det / 2
    return np.array([m[0] + a, m[1] + b, math.sqrt(a * a + b * b + (uu + vv) / len(p))])


#: A trim never takes points that lie this near to the circle.
TRIM_FLOOR = 0.02


def robust_circle(p: np.ndarray, band: float = 0.005, rounds: int = 256, low: float = 0.02, high: float = 1.0, seed: int = 4713):
    """(circle, inliers, rms) of a trunk's slice: random triples, then three trims at two sigma, TRIM_FLOOR at least."""
    start = search_circle(p, band, rounds, low, high, 1 - 1e-9, seed)
    if start is None:
        return None
    own = p[np.abs(np.hypot(p[:, 0] - start[0], p[:, 1] - start[1]) - start[2]) <= band]
    fit = kasa(own)
    for _ in range(3):
        if fit is None:
            return None
        off = np.abs(np.hypot(own[:, 0] - fit[0], own[:, 1] - fit[1]) - fit[2])
        keep = off <= max(TRIM_FLOOR, 2 * math.sqrt((off * off).mean()))
        if keep.all() or keep.sum() < 3:
            break
        own = own[keep]
        fit = kasa(own)
    if fit is None:
        return None
    off = np.hypot(own[:, 0] - fit[0], own[:, 1] - fit[1]) - fit[2]
    return fit, len(own), math.sqrt((off * off).mean())


def breast_height(p: np.ndarray) -> tuple[float, str, int, float]:
    """Diameter in cm, method, inliers and rms of a slice."""
    if not len(p):
        return 0.0, "none", 0, 0.0
    found = robust_circle(p)
    if found is None:
        return 0.0, "centroid", 0, 0.0
    (_, _, r), inliers, rms = found
    if inliers >= 8 and 0.02 <= r <= 1 and rms <= 0.1:
        return 200 * r, "circle", inliers, rms
    return 0.0, "centroid", inliers, rms


def search_axis(normals: np.ndarray, iterations: int = 256, least: float = 0.02, seed: int = 4712) -> np.ndarray | None:
    """The direction that most normals are square to, by random pairs and a least-squares step."""
    if len(normals) < 2:
        return None
    limit = math.sin(math.radians(5))

    def make(k):
        a = np.cross(normals[k[:, 0]], normals[k[:, 1]])
        size = np.sqrt((a * a).sum(axis=1))
        return a[size > 0.05] / size[size > 0.05][:, None]

    def count(models):
        # Normals of a plane are square to many axes; what counts is that they also spread around it.
        out = []
        for a in models:
            own = normals[np.abs((normals * a).sum(axis=1)) <= limit]
            m = (own[:, :, None] * own[:, None]).sum(axis=0) if len(own) else np.zeros((3, 3))
            out.append(2 * np.linalg.eigvalsh(m)[1])
        return np.array(out)

    best = _search(len(normals), 2, iterations, 1 - 1e-12, seed, make, count)
    if best is None:
        return None
    own = normals[np.abs((normals * best).sum(axis=1)) <= limit]
    if len(own) < max(3, least * len(normals)):
        return None
    return positive(np.linalg.eigh((own[:, :, None] * own[:, None]).sum(axis=0))[1][:, 0])


def basis(axis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two unit vectors square to a unit axis and to each other."""
    other = np.eye(3)[np.abs(axis).argmin()]
    u = np.cross(axis, other)
    u /= np.sqrt((u * u).sum())
    return u, np.cross(axis, u)


def align(a: np.ndarray, b: np.ndarray, scale: bool = False, weights: np.ndarray | None = None):
    """(R, t, s) that brings a to b with least squares; None if undetermined."""
    if len(a) != len(b) or len(a) < 3:
        return None
    w = np.ones(len(a)) if weights is None else weights
    w = w / w.sum()
    ca, cb = (a * w[:, None]).sum(axis=0), (b * w[:, None]).sum(axis=0)
    x, y = a - ca, b - cb
    return align_moments(ca, cb, (x[:, :, None] * x[:, None] * w[:, None, None]).sum(axis=0), (x[:, :, None] * y[:, None] * w[:, None, None]).sum(axis=0), scale)


def align_moments(ca: np.ndarray, cb: np.ndarray, xx: np.ndarray, s: np.ndarray, scale: bool = False):
    """(R, t, s) by the largest eigenvector of Horn's matrix, from both centres and the centred second moments x x' and x y'."""
    spread = np.linalg.eigvalsh(xx)
    if spread[1] <= 1e-12 * max(spread[2], 1e-300):
        return None  # all on one line
    z = np.array([s[1, 2] - s[2, 1], s[2, 0] - s[0, 2], s[0, 1] - s[1, 0]])
    m = np.empty((4, 4))
    m[0, 0], m[0, 1:], m[1:, 0] = np.trace(s), z, z
    m[1:, 1:] = s + s.T - np.trace(s) * np.eye(3)
    q0, qx, qy, qz = np.linalg.eigh(m)[1][:, 3]
    r = np.array([
        [q0 * q0 + qx * qx - qy * qy - qz * qz, 2 * (qx * qy - q0 * qz), 2 * (qx * qz + q0 * qy)],
        [2 * (qx * qy + q0 * qz), q0 * q0 - qx * qx + qy * qy - qz * qz, 2 * (qy * qz - q0 * qx)],
        [2 * (qx * qz - q0 * qy), 2 * (qy * qz + q0 * qx), q0 * q0 - qx * qx - qy * qy + qz * qz],
    ])
    # The mean of (R x) y is the sum of R and x y', element by element.
    k = float((r * s.T).sum() / np.trace(xx)) if scale else 1.0
    return r, cb - k * apply(r, np.zeros(3), 1.0, ca[None])[0], k


def limited(found, ca: np.ndarray, cb: np.ndarray, axis: str | None = None, fixed: str = ""):
    """A transform that keeps, of its rotation, the part about one axis ("none": nothing), and does not move along ``fixed`` axes.

    After a rotation is limited, the centres are brought together again.
    """
    r, t, s = found
    if axis is not None:
        at = {"x": (1, 2), "y": (2, 0), "z": (0, 1)}.get(axis)
        kept = np.eye(3)
        if at:
            i, j = at
            turn = math.atan2(r[j, i], r[i, i]) if axis == "z" else math.atan2(r[2, 1], r[2, 2]) if axis == "x" else math.atan2(-r[2, 0], r[2, 2])
            kept[i, i] = kept[j, j] = math.cos(turn)
            kept[j, i], kept[i, j] = math.sin(turn), -math.sin(turn)
        r, t = kept, cb - s * apply(kept, np.zeros(3), 1.0, ca[None])[0]
    return r, np.array([0.0 if n in fixed else v for n, v in zip("xyz", t, strict=True)]), s


def apply(r: np.ndarray, t: np.ndarray, s: float, p: np.ndarray) -> np.ndarray:
    """s R p + t for each row of p."""
    return s * np.stack([(p * r[k]).sum(axis=1) for k in range(3)], axis=1) + t


class Grid:
    """Nearest neighbours among a bounded number of points."""

    def __init__(self, p: np.ndarray, per_cell: float = 2.0):
        self.low = p.min(axis=0)
        extent = np.maximum(p.max(axis=0) - self.low, 1e-12)
        self.size = float(max((extent.prod() * per_cell / len(p)) ** (1 / 3), extent.max() / 512))
        self.shape = np.floor(extent / self.size).astype(np.int64) + 1
        key = self._key(self._cell(p))
        self.order = np.argsort(key, kind="stable")
        self.p = p[self.order]
        self.keys, counts = np.unique(key, return_counts=True)
        self.to = np.concatenate([[0], np.cumsum(counts)])

    def _cell(self, p):
        return np.clip(np.floor((p - self.low) / self.size).astype(np.int64), 0, self.shape - 1)

    def _key(self, c):
        return (c[:, 0] * self.shape[1] + c[:, 1]) * self.shape[2] + c[:, 2]

    def nearest(self, q: np.ndarray, k: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Indices and squared distances of the k nearest, nearest first; exact."""
        n = len(q)
        k = min(k, len(self.p))
        best, where = np.full((n, k), np.inf), np.zeros((n, k), dtype=np.int64)
        todo, reach = np.arange(n), 1
        cell = self._cell(q)
        while len(todo):
            span = [np.arange(-min(reach, m - 1), min(reach, m - 1) + 1) for m in self.shape.tolist()]
            if math.prod(map(len, span)) > max(27, 2 * len(self.p)):  # more cells than points: look at all of them
                for at in range(0, len(todo), max(1, 1_000_000 // len(self.p))):
                    own = todo[at : at + max(1, 1_000_000 // len(self.p))]
                    d = ((q[own][:, None] - self.p[None]) ** 2).sum(axis=2)
                    top = np.lexsort((np.broadcast_to(self.order, d.shape), d), axis=1)[:, :k]
                    best[own], where[own] = np.take_along_axis(d, top, axis=1), self.order[top]
                break
            around = np.stack(np.meshgrid(*span, indexing="ij"), axis=-1).reshape(-1, 3)
            whole = (reach >= self.shape).all()
            done = np.zeros(len(todo), dtype=bool)
            step = max(1, 2_000_000 // (len(around) * 4))
            for at in range(0, len(todo), step):
                own = todo[at : at + step]
                c = cell[own][:, None] + around[None]
                ok = ((c >= 0) & (c < self.shape)).all(axis=2)
                key = self._key(np.where(ok[..., None], c, 0).reshape(-1, 3))
                spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = np.flatnonzero((self.keys[spot] == key) & ok.reshape(-1))
                row, spot = hit // len(around), spot[hit]
                m = self.to[spot + 1] - self.to[spot]
                row = np.repeat(row, m)
                idx = np.repeat(self.to[spot], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                d = ((self.p[idx] - q[own][row]) ** 2).sum(axis=1)
                order = np.lexsort((self.order[idx], d, row))
                row, idx, d = row[order], idx[order], d[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                top = rank < k
                got, at_ = np.full((len(own), k), np.inf), np.zeros((len(own), k), dtype=np.int64)
                got[row[top], rank[top]], at_[row[top], rank[top]] = d[top], self.order[idx[top]]
                best[own], where[own] = got, at_
                # The box reaches this far from the query on every side, unless it ends the grid there.
                inside = np.minimum(q[own] - (self.low + (cell[own] - reach) * self.size), (self.low + (cell[own] + reach + 1) * self.size) - q[own]).min(axis=1)
                done[at : at + step] = whole | ((inside > 0) & (got[:, -1] <= inside * inside))
            todo = todo[~done]
            reach *= 2
        return where, best


def icp(data: np.ndarray, model: np.ndarray, rounds: int = 20, least: float = 1e-5, overlap: float = 1.0, scale: bool = False):
    """(R, t, s, rms of each round) that brings data onto model by nearest points."""
    if not 0 < overlap <= 1 or min(len(data), len(model)) < 3:
        raise ValueError("overlap must lie in (0, 1], and both clouds need three points")
    grid = Grid(model)
    r, t, s = np.eye(3), np.zeros(3), 1.0
    now, told = data, []
    keep = np.ones(len(data), dtype=bool)
    for _ in range(rounds):
        where, d2 = grid.nearest(now)
        d = np.sqrt(d2[:, 0])
        if told:  # far points go for good
            mu, sigma = d[keep].mean(), d[keep].std()
            if sigma > 0:
                keep &= d <= mu + 2.5 * sigma
        own = keep.copy()
        if overlap < 1:
            own &= d <= np.partition(d[keep], max(0, int(overlap * keep.sum()) - 1))[max(0, int(overlap * keep.sum()) - 1)]
        if own.sum() < 3:
            break
        rms = math.sqrt((d[own] ** 2).mean())
        if told and (rms > told[-1] or told[-1] - rms < least):
            told.append(min(rms, told[-1]))
            if rms > told[-2]:
                r, t, s = last
            break
        told.append(rms)
        found = align(now[own], model[where[own, 0]], scale)
        if found is None:
            break
        last = (r, t, s)
        dr, dt, ds = found
        r, t, s = np.stack([(dr[i][:, None] * r).sum(axis=0) for i in range(3)]), apply(dr, dt, ds, t[None])[0], s * ds
        now = apply(r, t, s, data)
    return r, t, s, told


def plane_covariances(p: np.ndarray, k: int = 20, eps: float = 1e-3) -> np.ndarray:
    """Covariance of each point's surroundings, flattened to a disc of thickness eps."""
    where, _ = Grid(p).nearest(p, k)
    near = p[where]
    d = near - near.mean(axis=1, keepdims=True)
    _, v = np.linalg.eigh((d[:, :, :, None] * d[:, :, None]).mean(axis=1))
    w = np.array([eps, 1.0, 1.0])
    return (v[:, :, None] * w * v[:, None]).sum(axis=3)


def gicp(data: np.ndarray, model: np.ndarray, rounds: int = 20, least: float = 1e-5, k: int = 20):
    """(R, t, rms of each round): plane-to-plane registration by Gauss-Newton steps."""
    if k < 3 or min(len(data), len(model)) < k:
        raise ValueError("k must be 3 at least, and both clouds need k points")
    grid, cd, cm = Grid(model), plane_covariances(data, k), plane_covariances(model, k)
    r, t, told = np.eye(3), np.zeros(3), []
    for _ in range(rounds):
        now = apply(r, t, 1.0, data)
        where, d2 = grid.nearest(now)
        rms = math.sqrt(d2[:, 0].mean())
        if told and abs(told[-1] - rms) < least:
            told.append(rms)
            break
        told.append(rms)
        turned = np.einsum("ij,njk,lk->nil", r, cd, r)
        weight = np.linalg.inv(cm[where[:, 0]] + turned)
        e = now - model[where[:, 0]]
        j = np.zeros((len(e), 3, 6))
        j[:, :, 3:] = np.eye(3)
        x, y, z = now.T
        j[:, 0, 1], j[:, 0, 2], j[:, 1, 0], j[:, 1, 2], j[:, 2, 0], j[:, 2, 1] = z, -y, -z, x, y, -x
        jw = np.einsum("nij,nik->njk", j, weight)
        h, g = np.einsum("nij,njk->ik", jw, j), np.einsum("nij,nj->i", jw, e)
        step = -np.linalg.solve(h + 1e-9 * np.trace(h) * np.eye(6), g)
        a = float(np.sqrt((step[:3] ** 2).sum()))
        k3 = np.array([[0, -step[2], step[1]], [step[2], 0, -step[0]], [-step[1], step[0], 0]])
        dr = np.eye(3) if a < 1e-15 else np.eye(3) + math.sin(a) / a * k3 + (1 - math.cos(a)) / a**2 * np.einsum("ij,jk->ik", k3, k3)
        r, t = np.einsum("ij,jk->ik", dr, r), apply(dr, step[3:], 1.0, t[None])[0]
    return r, t, told
