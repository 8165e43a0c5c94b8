"""Normal estimation, its orientation, and the radius to take."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..kernels import normals as K
from ..plans.lineage import written
from .aggregates import neighbourhood_moments
from .joins import range_join

GROWTH, MOST = 2**0.25, 16.0
_SUMS = ["n", "sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz"]
ORIENTATIONS = ("undefined", "+x", "-x", "+y", "-y", "+z", "-z", "+center", "-center", "previous")


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        m = {k: b.column(k).to_numpy(zero_copy_only=False) for k in _SUMS}
        n = K.plane_normals(m)
        yield pa.record_batch([b.column("ord"), *[pa.array(n[:, k]) for k in range(3)]], names=["ord", "nx", "ny", "nz"])


def features(points: DataFrame, radius: float) -> DataFrame:
    """(ord, n, dx, dy, dz, linearity, verticality) of neighbourhoods, the point included; a lone point has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d, linear, upright = K.line_features({k: b.column(k).to_numpy(zero_copy_only=False) for k in _SUMS})
                yield pa.record_batch([b.column("ord"), b.column("n"), *[pa.array(d[:, k]) for k in range(3)], pa.array(linear), pa.array(upright)], names=["ord", "n", "dx", "dy", "dz", "linearity", "verticality"])

    return neighbourhood_moments(points, radius).select("ord", *_SUMS).mapInArrow(run, "ord long, n long, dx double, dy double, dz double, linearity double, verticality double")


#: Powers of u and v in a quadric's terms: 1, u, v, uu, uv, vv.
_TERMS = [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2)]


def _quadric(near: DataFrame, planes: DataFrame) -> DataFrame:
    """(ord, nx, ny, nz): the plane's normal corrected by the slope, at the point, of a quadric over its plane.

    near: pairs (a, b) of at least six for each a; planes: (ord, nx, ny, nz). The normal
    equations are sums over the neighbours in the plane's frame.
    """
    n = {k: F.col(f"n{k}") for k in "xyz"}
    # Two directions square to the normal, without a case that vanishes.
    sign = F.when(n["z"] < 0, -1.0).otherwise(1.0)
    a = F.lit(-1.0) / (sign + n["z"])
    b = n["x"] * n["y"] * a
    frame = planes.withColumns({"ux": 1 + sign * n["x"] * n["x"] * a, "uy": sign * b, "uz": -sign * n["x"], "vx": b, "vy": sign + n["y"] * n["y"] * a, "vz": -n["y"]})
    d = {k: F.col(f"b.{k}") - F.col(f"a.{k}") for k in "xyz"}
    along = lambda axis: d["x"] * F.col(f"{axis}x") + d["y"] * F.col(f"{axis}y") + d["z"] * F.col(f"{axis}z")
    each = near.join(frame, F.col("a.ord") == F.col("ord")).select("ord", "nx", "ny", "nz", "ux", "uy", "uz", "vx", "vy", "vz", along("u").alias("u"), along("v").alias("v"), along("n").alias("h"))
    powers = sorted({(i + k, j + m) for i, j in _TERMS for k, m in _TERMS})
    power = lambda i, j: F.pow("u", F.lit(i)) * F.pow("v", F.lit(j))
    frame_columns = ["nx", "ny", "nz", "ux", "uy", "uz", "vx", "vy", "vz"]
    sums = each.groupBy("ord").agg(*[F.first(c).alias(c) for c in frame_columns], *[F.sum(power(i, j)).alias(f"s{i}{j}") for i, j in powers], *[F.sum(power(i, j) * F.col("h")).alias(f"h{i}{j}") for i, j in _TERMS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names}
            m = np.stack([np.stack([c[f"s{i + k}{j + q}"] for k, q in _TERMS], axis=1) for i, j in _TERMS], axis=1)
            h = np.stack([c[f"h{i}{j}"] for i, j in _TERMS], axis=1)
            w = np.sqrt(np.einsum("nii->ni", m)) + 1e-300  # terms of one size
            fit = np.einsum("nij,nj->ni", np.linalg.pinv(m / w[:, :, None] / w[:, None], rcond=1e-10, hermitian=True), h / w) / w
            out = np.stack([c[f"n{k}"] - fit[:, 1] * c[f"u{k}"] - fit[:, 2] * c[f"v{k}"] for k in "xyz"], axis=1)
            out /= np.sqrt((out * out).sum(axis=1))[:, None]
            yield pa.record_batch([batch.column("ord"), *[pa.array(out[:, k]) for k in range(3)]], names=["ord", "nx", "ny", "nz"])

    return sums.mapInArrow(run, "ord long, nx double, ny double, nz double")


def estimate(points: DataFrame, radius: float, orientation: str = "undefined", model: str = "plane") -> DataFrame:
    """(ord, nx, ny, nz, code) of all points; null where even 16 times the radius holds too few points.

    model is plane (three points at least) or quadric (six). Points with too few neighbours
    are tried again at a radius larger by a fourth root of two.
    """
    if orientation not in ORIENTATIONS:
        raise ValueError(f"orientation is one of {', '.join(ORIENTATIONS)}")
    if model not in ("plane", "quadric"):
        raise ValueError("model is plane or quadric")
    least = 3 if model == "plane" else 6
    left, out, r = points, None, radius
    while radius > 0 and r <= radius * MOST * 1.0001:
        near = range_join(left.select("ord", "x", "y", "z"), points.select("ord", "x", "y", "z"), r)
        d = {n: F.col(f"b.{n}") - F.col(f"a.{n}") for n in "xyz"}
        names = [*"xyz", "xx", "xy", "xz", "yy", "yz", "zz"]
        sums = near.groupBy(F.col("a.ord").alias("ord")).agg(F.count("*").alias("n"), *[F.sum(d[k] if len(k) == 1 else d[k[0]] * d[k[1]]).alias(f"s{k}") for k in names])
        done = sums.where(F.col("n") >= least).select("ord", *_SUMS).mapInArrow(_fit, "ord long, nx double, ny double, nz double")
        done = written(done if model == "plane" else _quadric(near, written(done)))
        out = done if out is None else out.unionByName(done)
        left = written(left.join(done.select("ord"), "ord", "left_anti"))
        if left.isEmpty():
            break
        r *= GROWTH
    if out is None:
        return points.select("ord", *[F.lit(None).cast("double").alias(k) for k in ("nx", "ny", "nz")], F.lit(K.NONE).alias("code"))
    found = points.join(out, "ord", "left")
    sign = F.lit(1.0)
    if orientation[1:] in ("x", "y", "z"):
        along = F.col(f"n{orientation[1:]}")
        sign = F.when(along < 0, -1.0).otherwise(1.0) * (1.0 if orientation[0] == "+" else -1.0)
    elif orientation.endswith("center"):
        c = points.agg(*[F.avg(n).alias(f"c{n}") for n in "xyz"])
        found = found.crossJoin(F.broadcast(c))  # one row
        along = sum(((F.col(n) - F.col(f"c{n}")) * F.col(f"n{n}") for n in "xyz"), F.lit(0.0))
        sign = F.when(along < 0, -1.0).otherwise(1.0) * (1.0 if orientation[0] == "+" else -1.0)
    elif orientation == "previous" and "normal_code" in points.columns:
        found = found.withColumn("old", decoded(F.col("normal_code")))
        sign = F.when(sum((F.col("old")[k] * F.col(f"n{n}") for k, n in enumerate("xyz")), F.lit(0.0)) < 0, -1.0).otherwise(1.0)
    found = found.select("ord", *[(F.col(f"n{n}") * sign).alias(f"n{n}") for n in "xyz"])
    return found.withColumn("code", F.coalesce(encoded(F.array("nx", "ny", "nz")), F.lit(K.NONE)))


def encoded(vector):
    """Codes of vectors (array of three doubles); none for null."""
    @pandas_udf("int")
    def run(v: pd.Series) -> pd.Series:
        ok = np.array([x is not None and not any(c is None or np.isnan(c) for c in x) for x in v], dtype=bool)
        out = np.full(len(v), K.NONE, dtype=np.int32)
        if ok.any():
            out[ok] = K.encode(np.stack([np.asarray(x, dtype=float) for x, k in zip(v, ok, strict=True) if k]))
        return pd.Series(out)

    return run(vector)


def decoded(code):
    """Unit vectors of codes; zero where there is none."""
    @pandas_udf("array<double>")
    def run(c: pd.Series) -> pd.Series:
        return pd.Series(list(K.unit(c.fillna(K.NONE).to_numpy())))

    return run(code)


def auto_radius(points: DataFrame, start: float, target: int = 16, slack: int = 4, share: float = 0.97, least: int = 6, rounds: int = 10, probes: int = 200) -> float:
    """A radius at which a few probes have about ``target`` neighbours, and nearly all at least ``least``."""
    chosen = points.orderBy(F.xxhash64("ord"), "ord").limit(probes).select("ord", "x", "y", "z")
    r = start
    for _ in range(rounds):
        near = range_join(chosen, points.select("ord", "x", "y", "z"), r).groupBy("a.ord").agg(F.count("*").alias("n"))
        got = near.agg(F.avg("n").alias("mean"), F.avg((F.col("n") >= least).cast("double")).alias("share")).first()
        if got["mean"] is None:
            return r
        if abs(got["mean"] - target) <= slack and got["share"] >= share:
            break
        # Neighbours on a surface grow with the square of the radius.
        factor = (target / max(got["mean"], 1.0)) ** 0.5
        if got["share"] < share:
            factor = max(factor, GROWTH)
        r *= min(2.0, max(0.5, factor))
    return r
