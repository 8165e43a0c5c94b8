"""Trees: diameters at breast height, markers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.fits import breast_height
from .aggregates import tree_metrics

#: Slice points that a circle is fitted on, chosen by a hash of ord.
SLICE_POINTS = 20_000


def diameters(points: DataFrame, dbh_height: float = 1.3, thickness: float = 0.1, crown_ratio: float = 0.3, base_quantile: float = 0.0) -> DataFrame:
    """Metrics of each tree (entity_id) with dbh in cm, its method (none, centroid, circle), inliers and rms."""
    metrics = tree_metrics(points, dbh_height, thickness, crown_ratio, base_quantile)
    base = metrics.select("entity_id", "base_z")
    inside = F.col("z").between(F.col("base_z") + dbh_height - thickness / 2, F.col("base_z") + dbh_height + thickness / 2)
    slices = points.join(base, "entity_id").where(inside).select("entity_id", "ord", "x", "y")
    slices = slices.withColumn("__r", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.xxhash64("ord"), "ord"))).where(F.col("__r") <= SLICE_POINTS)

    def fit(table: pa.Table) -> pa.Table:
        t = table.sort_by("ord")
        dbh, method, inliers, rms = breast_height(np.stack([t["x"].to_numpy(), t["y"].to_numpy()], axis=1).astype(float))
        return pa.table({"entity_id": t["entity_id"][:1], "dbh": [dbh], "dbh_method": [method], "dbh_inliers": pa.array([inliers], pa.int64()), "dbh_rms": [rms]})

    fits = slices.groupBy("entity_id").applyInArrow(fit, "entity_id int, dbh double, dbh_method string, dbh_inliers long, dbh_rms double")
    return metrics.join(fits, "entity_id", "left").withColumns({"dbh": F.coalesce("dbh", F.lit(0.0)), "dbh_method": F.coalesce("dbh_method", F.lit("none"))})


def ring(centers: DataFrame, radius: str, segments: int = 64) -> DataFrame:
    """centers with the corners (k, px, py) of a ring around each."""
    turn = F.col("k") * (2 * math.pi / segments)
    each = centers.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))))
    return each.withColumns({"px": F.col("x") + F.col(radius) * F.cos(turn), "py": F.col("y") + F.col(radius) * F.sin(turn)})


def isolate_trees(points: DataFrame, cell1: float = 0.05, near1: int = 5, strength1: float = 1.0, cell2: float = 0.1, near2: int = 10, gap: float = 2.0, strength2: float = 10.0, near3: int = 10, lift: float = 0.5, vertical: float = 0.5) -> DataFrame:
    """points (entity_id, ord, x, y, z; without ground) with tree 1..K within each entity.

    An entity, a plot, is one task: the graph cuts look at all of it. Points that share a
    cell of the first grid are thinned to one before they reach that task, and get its tree
    afterwards, so a task holds no more points than its plot has cells.
    """
    from ..kernels.trees import TreeParams, isolate

    params = TreeParams(cell1, near1, strength1, cell2, near2, gap, strength2, near3, lift, vertical)
    low = points.groupBy("entity_id").agg(*[F.min(n).alias(f"__{n}") for n in "xyz"])
    keys = [f"__c{n}" for n in "xyz"]
    own = points.join(low, "entity_id").withColumns({f"__c{n}": F.floor((F.col(n) - F.col(f"__{n}")) / cell1) for n in "xyz"}).drop(*[f"__{n}" for n in "xyz"])
    first = own.groupBy("entity_id", *keys).agg(F.min_by(F.struct("ord", "x", "y", "z"), "ord").alias("p")).select("entity_id", *keys, "p.*")

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("ord")
        tree = isolate(np.stack([t[n].to_numpy().astype(float) for n in "xyz"], axis=1), params)
        return t.select(["entity_id", *keys]).append_column("tree", pa.array(tree.astype(np.int32)))

    schema = ", ".join(["entity_id " + dict(points.dtypes)["entity_id"], *[f"{k} bigint" for k in keys], "tree int"])
    trees = first.groupBy("entity_id").applyInArrow(run, schema)
    return own.join(trees, ["entity_id", *keys]).drop(*keys)
