"""Ground: filled rasters, height above ground, the liquid cloth, power-line candidates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.raster import fill_holes, settle_cloth
from .aggregates import ground_raster
from .filters import hag_gate, loose_line_gate
from .joins import raster_lookup
from .normals import features

PARTICLES = 1 << 24


def filled_raster(points: DataFrame, size: float = 5.0) -> tuple[DataFrame, dict] | None:
    """The ground raster with its holes filled: at most a million cells, brought to the driver."""
    cells, grid = ground_raster(points, size)
    found = cells.collect()  # no more cells than the raster's cap
    if not found:
        return None
    z = np.full((grid["rows"], grid["cols"]), np.nan, dtype=np.float32)
    for r in found:
        z[r["row"], r["col"]] = r["z"]
    return _frame(points.sparkSession, fill_holes(z)), grid


def _frame(spark, z: np.ndarray) -> DataFrame:
    import pandas as pd

    rows, cols = z.shape
    return spark.createDataFrame(pd.DataFrame({"col": np.tile(np.arange(cols), rows), "row": np.repeat(np.arange(rows), cols), "z": z.reshape(-1).astype(float)}))


def with_ground(points: DataFrame, ground: DataFrame, size: float = 5.0) -> DataFrame:
    """points with ground, sampled from the raster of the ground points; null where there are none."""
    found = filled_raster(ground, size)
    if found is None:
        return points.withColumn("ground", F.lit(None).cast("double"))
    raster, grid = found
    return raster_lookup(points, raster, grid["cols"], grid["rows"], grid["size"], grid["origin"])


def line_candidates(points: DataFrame, ground: DataFrame, height: float = 4.0, radius: float = 1.0, cell: float = 5.0) -> DataFrame:
    """Points high above ground whose surroundings are linear and level, with their features."""
    high = hag_gate(with_ground(points, ground, cell), height).drop("ground")
    return high.join(loose_line_gate(features(high, radius)), "ord")


def classify_ground(points: DataFrame, resolution: float = 0.6, threshold: float = 0.4, rigidness: int = 2, iterations: int = 500, step: float = 0.65, eps: float = 1e-3) -> DataFrame:
    """points with ground (boolean) by a cloth that falls on the cloud turned over.

    The support of a particle, the highest inverted point within 1.5 resolutions, does not
    change while the cloth falls; it is one aggregation over all points. The cloth itself
    has a bounded number of particles and settles on the driver. A point is ground if it
    lies within the threshold of the cloth, the border included.
    """
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.max("z").alias("z1")).first()
    if box["x0"] is None:
        return points.withColumn("ground", F.lit(False))
    r = resolution
    if not r > 0:
        raise ValueError("the resolution must be positive")
    nx, ny = int((box["x1"] - box["x0"]) / r) + 2, int((box["y1"] - box["y0"]) / r) + 2
    if nx * ny > PARTICLES:
        raise ValueError(f"{nx * ny} particles are too many: raise the resolution")
    reach = 1.5 * r
    span = F.sequence(F.lit(-2), F.lit(2))
    p = points.select((F.col("x") - box["x0"]).alias("x"), (F.col("y") - box["y0"]).alias("y"), (-F.col("z")).alias("h"), F.floor((F.col("x") - box["x0"]) / r + 0.5).cast("int").alias("i"), F.floor((F.col("y") - box["y0"]) / r + 0.5).cast("int").alias("j"))
    p = p.withColumn("i", F.explode(F.transform(span, lambda k: F.col("i") + k))).withColumn("j", F.explode(F.transform(span, lambda k: F.col("j") + k)))
    dx, dy = F.col("x") - F.col("i") * r, F.col("y") - F.col("j") * r
    near = p.where(F.col("i").between(0, nx - 1) & F.col("j").between(0, ny - 1) & (dx * dx + dy * dy <= reach * reach))
    support = np.full((ny, nx), -math.inf)
    found = near.groupBy("i", "j").agg(F.max("h").alias("h")).toPandas()  # no more rows than particles
    support[found["j"].to_numpy(), found["i"].to_numpy()] = found["h"].to_numpy()
    cloth = settle_cloth(support, -box["z1"] + 2 * r, r, rigidness, iterations, step, eps)
    seen = raster_lookup(points, _frame(points.sparkSession, cloth), nx, ny, r, (box["x0"], box["y0"]))
    return seen.withColumn("ground", F.coalesce(F.abs(-F.col("z") - F.col("ground")) <= threshold, F.lit(False)))


def classify_ground_elastic(points: DataFrame, resolution: float, threshold: float, rigidness: int = 2, iterations: int = 500, step: float = 0.65, smooth: bool = False, up: str = "z") -> DataFrame:
    """points with ground (boolean) by an elastic cloth under the cloud, turned over along ``up``.

    A particle's ground is the point nearest to it in plan, ties to the smallest ord: one
    aggregation over all points. The sweep over the cloth is sequential by nature and runs
    on the driver over a bounded number of particles. A point is ground if it lies strictly
    nearer to the cloth than the threshold. A resolution that is not positive finds none.
    """
    from ..kernels import cloth as K

    if not resolution > 0:
        return points.withColumn("ground", F.lit(False))
    a, b = [n for n in "xyz" if n != up]
    box = points.agg(F.min(a).alias("a0"), F.max(a).alias("a1"), F.min(b).alias("b0"), F.max(b).alias("b1"), F.min(up).alias("h0")).first()
    if box["a0"] is None:
        return points.withColumn("ground", F.lit(False))
    r = resolution
    cols, rows = (int((box[f"{n}1"] - box[f"{n}0"]) // r) + 2 * K.BUFFER for n in "ab")
    if cols * rows > PARTICLES:
        raise ValueError(f"{cols * rows} particles are too many: raise the resolution")
    origin = (box["a0"] - K.BUFFER * r, box["b0"] - K.BUFFER * r)
    spot = points.select("ord", (-F.col(up)).alias("h"), F.col(a).alias("a"), F.col(b).alias("b"), F.floor((F.col(a) - origin[0]) / r + 0.5).cast("int").alias("i"), F.floor((F.col(b) - origin[1]) / r + 0.5).cast("int").alias("j"))
    gap = F.pow(F.col("i") * r + origin[0] - F.col("a"), 2) + F.pow(F.col("j") * r + origin[1] - F.col("b"), 2)
    found = spot.groupBy("i", "j").agg(F.min_by("h", F.struct(gap.alias("d"), "ord")).alias("h")).toPandas()  # no more rows than particles
    heights = np.full((rows, cols), np.nan)
    ok = (found["i"] >= 0) & (found["i"] < cols) & (found["j"] >= 0) & (found["j"] < rows)
    heights[found["j"][ok], found["i"][ok]] = found["h"][ok]
    cloth = K.simulate(heights, -box["h0"] + K.LIFT, rigidness, iterations, step, smooth)
    plan = points.withColumns({"__x": F.col("x"), "__y": F.col("y"), "x": F.col(a), "y": F.col(b), "__h": -F.col(up)})
    seen = raster_lookup(plan, _frame(points.sparkSession, cloth), cols, rows, r, origin)
    seen = seen.withColumns({"x": F.col("__x"), "y": F.col("__y"), "ground": F.coalesce(F.abs(F.col("ground") - F.col("__h")) < threshold, F.lit(False))})
    return seen.drop("__x", "__y", "__h")
