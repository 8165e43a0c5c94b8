"""Plane and cylinder fits: hypotheses on a bounded sample, then passes over all points."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import fits
from ..kernels.normals import NONE, unit
from .aggregates import extent_along, kasa_circle, moments
from .filters import cylinder_inliers, plane_distance, plane_inliers
from .sample import sample

SAMPLE = 65_536


@dataclass
class Plane:
    normal: tuple[float, float, float]
    d: float
    inliers: int
    rms: float
    quad: dict = field(default_factory=dict)


@dataclass
class Cylinder:
    axis: tuple[float, float, float]
    center: tuple[float, float, float]
    radius: float
    half_height: float
    inliers: int


def fit_plane(points: DataFrame, threshold: float, iterations: int = 1000, refine: bool = True, size: int = SAMPLE, confidence: float = 0.99) -> Plane | None:
    """The plane with most points within the threshold; None if there are too few points or rounds.

    The least-squares plane of the inliers, from their moments, replaces the sampled one
    where it has strictly more inliers.
    """
    threshold = max(threshold, 0.0)
    best = fits.search_plane(sample(points, size), threshold, iterations, confidence)
    if best is None:
        return None

    def scan(model):
        n, d = tuple(map(float, model[:3])), float(model[3])
        got = plane_inliers(points, n, d, threshold).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(plane_distance(n, d), 2))).alias("rms")).first()
        return n, d, got["n"], got["rms"] or 0.0

    best[:3], best[3] = (best[:3], best[3]) if best[np.abs(best[:3]).argmax()] > 0 else (-best[:3], -best[3])
    found = scan(best)
    if refine and found[2] >= 3:
        m = moments(plane_inliers(points, found[0], found[1], threshold)).first()
        mean = np.array([m["sx"], m["sy"], m["sz"]]) / m["n"]
        around = moments(plane_inliers(points, found[0], found[1], threshold), tuple(map(float, mean))).first()
        c = np.array([[around["s" + "".join(sorted(a + b))] for b in "xyz"] for a in "xyz"])
        n = fits.positive(np.linalg.eigh(c)[1][:, 0])
        again = scan(np.append(n, -(n * mean).sum()))
        found = again if again[2] > found[2] else found
    u, v = fits.basis(np.array(found[0]))
    quad = extent_along(plane_inliers(points, found[0], found[1], threshold), {"u": tuple(map(float, u)), "v": tuple(map(float, v))}).first().asDict()
    return Plane(found[0], found[1], found[2], found[3], quad)


def fit_cylinder(points: DataFrame, threshold: float, axis: tuple | None = None, iterations: int = 1000, low: float = 0.0, high: float = 0.0, size: int = SAMPLE, confidence: float = 0.99) -> Cylinder | None:
    """The cylinder with most points within the threshold of its surface.

    Without an axis it comes from normal codes (column normal_code), which all points need;
    without them, or with an axis of no length, there is no result.
    """
    threshold = max(threshold, 0.0)
    if axis is None:
        if "normal_code" not in points.columns:
            return None
        codes = sample(points.where(F.col("normal_code") != NONE), size, ("normal_code",))[:, 0].astype(int)
        a = fits.search_axis(unit(codes)) if len(codes) else None
    else:
        a = np.array(axis, dtype=float)
        length = math.sqrt((a * a).sum())
        a = fits.positive(a / length) if length > 0 else None
    if a is None:
        return None
    u, v = fits.basis(a)
    p = sample(points, size)
    flat = np.stack([(p * u).sum(axis=1), (p * v).sum(axis=1)], axis=1)
    circle = fits.search_circle(flat, threshold, iterations, low, high, confidence)
    if circle is None:
        return None

    def scan(c):
        center = tuple(map(float, c[0] * u + c[1] * v))
        got = cylinder_inliers(points, tuple(map(float, a)), center, float(c[2]), threshold)
        return center, float(c[2]), got

    dot = lambda w: F.col("x") * float(w[0]) + F.col("y") * float(w[1]) + F.col("z") * float(w[2])
    center, radius, got = scan(circle)
    n = got.count()
    better = kasa_circle(got.select(dot(u).alias("x"), dot(v).alias("y"))).first()
    if better["r"] is not None and (better["r"] >= low) and (high <= 0 or better["r"] <= high):
        other = scan((better["cx"], better["cy"], better["r"]))
        m = other[2].count()
        if m > n:
            (center, radius, got), n = other, m
    span = extent_along(got, {"h": tuple(map(float, a))}).first()
    if span["min_h"] is None:
        return None
    middle = (span["min_h"] + span["max_h"]) / 2
    base = np.array(center)
    base = base + a * (middle - (base * a).sum())
    return Cylinder(tuple(map(float, a)), tuple(map(float, base)), radius, (span["max_h"] - span["min_h"]) / 2, n)
