"""Euclidean clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import connected_components
from .joins import range_pairs


def spacing_tolerance(spacing: float) -> float:
    """Three times the mean spacing, at least 0.001; 0.1 where there is none."""
    import math

    return max(3 * spacing, 0.001) if math.isfinite(spacing) and spacing > 0 else 0.1


def cluster(points: DataFrame, tolerance: float) -> DataFrame:
    """points with label 1..K and size: components of points within the tolerance, its border included.

    Labels are numbered by the first point of each component in order of ord. A tolerance
    that is not positive makes each point a cluster of its own. The numbers come from a
    window over one row a component.
    """
    if tolerance > 0:
        edges = range_pairs(points.select("ord", "x", "y", "z"), tolerance).select(F.col("a.ord").alias("a"), F.col("b.ord").alias("b"))
        rooted = points.join(connected_components(edges).withColumnRenamed("id", "ord"), "ord", "left").withColumn("root", F.coalesce("root", "ord"))
    else:
        rooted = points.withColumn("root", F.col("ord"))
    sizes = rooted.groupBy("root").agg(F.count("*").alias("size"))
    return rooted.join(sizes.join(numbered(sizes, "root", "label"), "root"), "root").drop("root")


def numbered(df: DataFrame, key: str, name: str, slices: int = 64) -> DataFrame:
    """(key, name): dense numbers from 1 in order of a unique key, without bringing all rows to one task.

    Keys are cut into ranges by sampled quantiles; a range's numbers begin behind those before it.
    """
    bounds = [b for b in df.approxQuantile(key, [k / slices for k in range(1, slices)], 0.005)] if not df.isEmpty() else []
    part = F.lit(0)
    for b in sorted(set(bounds)):
        part = part + (F.col(key) > b).cast("int")
    parted = df.select(key, part.alias("__p"))
    before = parted.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a range
    own = F.row_number().over(Window.partitionBy("__p").orderBy(key))
    return parted.join(F.broadcast(before.select("__p", "__b")), "__p").select(key, (own + F.col("__b")).cast("int").alias(name))
