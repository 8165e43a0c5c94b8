"""Sixteen-bit normal codes, and normals from moments."""

from __future__ import annotations

import numpy as np

LEVELS, NONE, FLIP = 6, 32768, 28672


def encode(n: np.ndarray) -> np.ndarray:
    """Codes of the rows of n: three sign bits, then six levels of a triangle cut in four.

    The absolute vector, divided by its sum, lies in the triangle x + y + z = 1. In
    barycentric terms a corner part is where one coordinate exceeds a half (z first, then y,
    then x) and the part in the middle is the triangle turned round. Zero vectors have no code.
    """
    n = np.asarray(n, dtype=float).reshape(-1, 3)
    code = ((n < 0) * np.array([4, 2, 1])).sum(axis=1)
    b = np.abs(n)
    total = b.sum(axis=1)
    none = ~(total > 0)
    b = b / np.where(none, 1, total)[:, None]
    for _ in range(LEVELS):
        over = b > 0.5
        part = np.where(over[:, 2], 2, np.where(over[:, 1], 1, np.where(over[:, 0], 0, 3)))
        corner = part < 3
        b = np.where(corner[:, None], 2 * b - (part[:, None] == np.arange(3)), 1 - 2 * b)
        code = code * 4 + part
    return np.where(none, NONE, code).astype(np.int32)


def decode(code: np.ndarray) -> np.ndarray:
    """Vectors (not of unit length) at the middle of each code's box; zero where there is no code."""
    code = np.asarray(code, dtype=np.int64)
    corner, size, way = np.zeros((len(code), 3)), np.ones(len(code)), np.ones(len(code))
    for level in range(LEVELS - 1, -1, -1):
        part = (code >> (2 * level)) & 3
        size = size / 2
        grow = (part[:, None] == np.arange(3)) | (part == 3)[:, None]
        corner = corner + grow * (way * size)[:, None]
        way = np.where(part == 3, -way, way)
    signs = 1 - 2 * ((code[:, None] >> (2 * LEVELS)) // np.array([4, 2, 1]) % 2)
    return np.where((code == NONE)[:, None], 0.0, signs * (2 * corner + (way * size)[:, None]))


def unit(code: np.ndarray) -> np.ndarray:
    v = decode(code)
    size = np.sqrt((v * v).sum(axis=1))
    return v / np.where(size > 0, size, 1)[:, None]


def covariances(m: dict[str, np.ndarray]) -> np.ndarray:
    """Covariance matrices from counts and sums (n, sx.., sxx..)."""
    n = m["n"].astype(float)
    mean = np.stack([m["sx"], m["sy"], m["sz"]], axis=1) / n[:, None]
    out = np.empty((len(n), 3, 3))
    for i, a in enumerate("xyz"):
        for j, b in enumerate("xyz"):
            out[:, i, j] = m[f"s{min(a, b)}{max(a, b)}"] / n - mean[:, i] * mean[:, j]
    return out


def plane_normals(m: dict[str, np.ndarray]) -> np.ndarray:
    """Unit normals of least-squares planes; the largest component is positive."""
    _, v = np.linalg.eigh(covariances(m))
    n = v[:, :, 0]
    big = np.take_along_axis(n, np.abs(n).argmax(axis=1)[:, None], axis=1)
    return n * np.where(big < 0, -1, 1)


def line_features(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Main directions, linearity (l1 - l2) / l1 and verticality |v1 z|; 0 where all points coincide."""
    w, v = np.linalg.eigh(covariances(m))
    top = np.maximum(w[:, 2], 0)
    linear = np.where(top > 0, (w[:, 2] - w[:, 1]) / np.where(top > 0, top, 1), 0.0)
    return v[:, :, 2], linear, np.abs(v[:, 2, 2])
