"""Registration of two clouds: point pairs, nearest points, plane to plane."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import fits
from .filters import bake
from .joins import point_pairs
from .sample import sample

LIMIT = 50_000


def as_dict(found) -> dict | None:
    return None if found is None else {"rotation": found[0].tolist(), "translation": found[1].tolist(), "scale": float(found[2])}


def align_pairs(left: DataFrame, right: DataFrame, scale: bool = False, axis: str | None = None, fixed: str = "") -> dict | None:
    """The transform that brings points onto their partners of equal index, over all pairs.

    None for fewer than three pairs, or where all lie on one line; three pairs are solved like
    more of them. axis: "x", "y" or "z" keeps only the rotation about that axis, "none" none
    of it; fixed: axes along which nothing moves, such as "xz". Moments are summed in Spark,
    about the first pair's points, so one row comes to the driver.
    """
    pairs = point_pairs(left, right)
    first = pairs.agg(F.min_by(F.struct("a", "b"), "index").alias("p")).first()["p"]
    if first is None:
        return None
    oa, ob = ({n: float(first[s][n]) for n in "xyz"} for s in "ab")
    x = {n: F.col(f"a.{n}") - oa[n] for n in "xyz"}
    y = {n: F.col(f"b.{n}") - ob[n] for n in "xyz"}
    sums = [F.avg(v).alias(f"{k}{n}") for k, own in (("x", x), ("y", y)) for n, v in own.items()]
    sums += [F.avg(x[m] * own[n]).alias(f"x{k}{m}{n}") for k, own in (("x", x), ("y", y)) for m in "xyz" for n in "xyz"]
    row = pairs.agg(F.count("*").alias("n"), *sums).first()
    if row["n"] < 3:
        return None
    ma, mb = (np.array([row[f"{k}{n}"] for n in "xyz"]) for k in "xy")
    xx, xy = (np.array([[row[f"x{k}{m}{n}"] for n in "xyz"] for m in "xyz"]) - np.outer(ma, v) for k, v in (("x", ma), ("y", mb)))
    ca, cb = ma + np.array(list(oa.values())), mb + np.array(list(ob.values()))
    found = fits.align_moments(ca, cb, xx, xy, scale)
    return None if found is None else as_dict(fits.limited(found, ca, cb, axis, fixed))


def icp(data: DataFrame, model: DataFrame, rounds: int = 20, least: float = 1e-5, overlap: float = 1.0, scale: bool = False, limit: int = LIMIT) -> dict | None:
    """Nearest-point registration on bounded samples, with the error of each round.

    overlap: the share of data points that have a partner; the others are trimmed in each
    round, so the data's sample is as much larger (ten times at most).
    """
    a, b = sample(data, min(int(limit / max(overlap, 0.1)), 10 * LIMIT), seed=1), sample(model, min(limit, LIMIT), seed=2)
    r, t, s, told = fits.icp(a, b, rounds, least, overlap, scale)
    return as_dict((r, t, s)) | {"rms": told}


def gicp(data: DataFrame, model: DataFrame, rounds: int = 20, least: float = 1e-5, k: int = 20, limit: int = LIMIT) -> dict:
    r, t, told = fits.gicp(sample(data, limit, seed=1), sample(model, limit, seed=2), rounds, least, k)
    return as_dict((r, t, 1.0)) | {"rms": told}


def moved(points: DataFrame, found: dict) -> DataFrame:
    return bake(points, found["rotation"], tuple(found["translation"]), found["scale"])
