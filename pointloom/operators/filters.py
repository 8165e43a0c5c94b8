"""Row-subset operators: the result is always some of the rows, never new points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import written
from .joins import AXES, neighbours
from .nearest import nearest


def radius_filter(points: DataFrame, radius: float, least: int = 2) -> DataFrame:
    """Points with ``least`` neighbours or more within the radius, the border included.

    A radius that is not positive drops all; least = 0 keeps all.
    """
    if not radius > 0:
        return points.limit(0)
    if least <= 0:
        return points
    counts = neighbours(points, radius).groupBy(F.col("a.ord").alias("ord")).agg(F.count("*").alias("__n"))
    return points.join(counts.where(F.col("__n") >= least).select("ord"), "ord", "left_semi")


def statistical_filter(points: DataFrame, k: int = 10, lam: float = 1.0, cell: float = 0.1) -> DataFrame:
    """Drop points whose mean squared distance to their k nearest exceeds mean + lam sigma over all points.

    Distances stay squared throughout; sigma is the population's. k = 0 keeps all; a negative
    lam counts as 0; a point with fewer neighbours uses those it has, one without has 0.
    """
    if k <= 0:
        return points
    own = written(nearest(points, points, k).groupBy("ord").agg(F.avg("d2").alias("__m")))
    each = points.join(own, "ord", "left").withColumn("__m", F.coalesce("__m", F.lit(0.0)))
    limit = each.agg((F.avg("__m") + max(lam, 0.0) * F.stddev_pop("__m")).alias("__limit"))
    return each.crossJoin(F.broadcast(limit)).where("__m <= __limit").drop("__m", "__limit")  # one row


def voxel_downsample(points: DataFrame, leaf: float, digits: int | None = None) -> DataFrame:
    """Of each cell of edge ``leaf`` the real point nearest to the cell's centroid, ties to the smallest ord.

    A leaf that is not positive keeps all. Coordinates are summed as decimals, exactly, so
    the centroid does not depend on the order of rows; both passes aggregate before they
    shuffle, so a cell may hold any share of the rows. digits: squared distances that are
    equal when rounded to so many decimals are ties; without, only equal doubles are, and of
    two points as far from their centroid the last bit of a sum may choose.
    """
    if not leaf > 0:
        return points
    keys = ["cx", "cy", "cz"]
    spots = points.select("ord", *AXES, *[F.floor(F.col(n) / F.lit(leaf)).cast("long").alias(f"c{n}") for n in AXES])
    exact = [(F.sum(F.col(n).cast("decimal(38,18)")).cast("double") * (F.lit(1.0) / F.count("*"))).alias(f"m{n}") for n in AXES]
    centers = spots.groupBy(keys).agg(*exact)
    gap = sum(((F.col(n) - F.col(f"m{n}")) * (F.col(n) - F.col(f"m{n}")) for n in AXES), F.lit(0.0))
    if digits is not None:
        gap = F.round(gap, digits)
    kept = spots.join(centers, keys).groupBy(keys).agg(F.min(F.struct(gap.alias("d2"), "ord")).alias("p")).select("p.ord")
    return points.join(kept, "ord", "left_semi")


def _project(matrix: list[float], orthographic: bool) -> tuple[Column, Column, Column]:
    """NDC x and y by a column-major matrix, and whether the point is seen."""
    x, y, z = (F.col(n).cast("double") for n in AXES)
    row = [matrix[k] * x + matrix[k + 4] * y + matrix[k + 8] * z + matrix[k + 12] for k in range(4)]
    w = row[3]
    return row[0] / w, row[1] / w, ((row[2] >= -w) & (row[2] <= w)) if orthographic else (w > 0)


def rectangle_selection(points: DataFrame, matrix: list[float], rect: tuple[float, float, float, float], orthographic: bool = False) -> DataFrame:
    """points with inside: seen, and within (min x, min y, max x, max y) in NDC, borders included."""
    nx, ny, seen = _project(matrix, orthographic)
    return points.withColumn("inside", F.coalesce(seen & nx.between(rect[0], rect[2]) & ny.between(rect[1], rect[3]), F.lit(False)))


def polygon_selection(points: DataFrame, matrix: list[float], polygon: list[tuple[float, float]], orthographic: bool = False) -> DataFrame:
    """points with inside by the even-odd rule; fewer than three vertices select nothing at all (no rows)."""
    if len(polygon) < 3:
        return points.limit(0).withColumn("inside", F.lit(False))
    nx, ny, seen = _project(matrix, orthographic)
    p = points.withColumns({"__nx": nx, "__ny": ny})
    odd = F.lit(0)
    for (xi, yi), (xj, yj) in zip(polygon, [polygon[-1], *polygon[:-1]], strict=True):
        if yi == yj:
            continue  # a level edge has both ends on one side of any point
        across = (F.lit(yi) > F.col("__ny")) != (F.lit(yj) > F.col("__ny"))
        odd = odd + (across & (F.col("__nx") < (xj - xi) * (F.col("__ny") - yi) / (yj - yi) + xi)).cast("int")
    box = F.col("__nx").between(min(a for a, _ in polygon), max(a for a, _ in polygon)) & F.col("__ny").between(min(b for _, b in polygon), max(b for _, b in polygon))
    return p.withColumn("inside", F.coalesce(seen & box & (odd % 2 == 1), F.lit(False))).drop("__nx", "__ny")


def split_by_class(points: DataFrame) -> DataFrame:
    """points with label 1.. by ascending class; no rows where there is one class alone."""
    classes = points.select("classification").distinct()
    labels = classes.withColumn("label", F.row_number().over(Window.orderBy("classification"))).withColumn("__n", F.count("*").over(Window.partitionBy()))  # 256 classes at most
    return points.join(F.broadcast(labels.where("__n >= 2").drop("__n")), "classification")


def set_class(points: DataFrame, value: int, where: Column | None = None) -> DataFrame:
    """A class of 0..255 for the chosen rows (all, if none are chosen)."""
    if not 0 <= value <= 255:
        raise ValueError("a class is 0..255")
    kind = points.schema["classification"].dataType
    new = F.lit(value).cast(kind)
    return points.withColumn("classification", new if where is None else F.when(where, new).otherwise(F.col("classification")))


def hag_gate(points: DataFrame, least: float) -> DataFrame:
    """Points at least so high above their ground; an unknown ground fails."""
    return points.where((F.col("z") - F.col("ground") >= least) & ~F.isnan(F.col("z") - F.col("ground")))


def loose_line_gate(features: DataFrame, pool: int = 4_000_000) -> DataFrame:
    """Linear, level enough neighbourhoods of three points or more; a pool above the bound is refused."""
    out = features.where("linearity >= 0.5 and abs(verticality) <= 0.5 and n >= 3")
    if out.count() > pool:
        raise ValueError(f"more than {pool} candidates: raise the minimum height")
    return out


def refine_lines(features: DataFrame, linearity: float = 0.85, slope_degrees: float = 25.0) -> DataFrame:
    """Both gates include their border, and never go below the loose gate."""
    import math

    steep = min(math.sin(math.radians(slope_degrees)), 0.5)
    return features.where((F.col("linearity") >= max(linearity, 0.5)) & (F.abs("verticality") <= steep))


def is_tree(points: DataFrame) -> DataFrame:
    """(entity_id, is_tree): there are points, and all are of class 4 or 5."""
    return points.groupBy("entity_id").agg(F.every(F.col("classification").isin(4, 5)).alias("is_tree"))


def kept_clusters(sizes: DataFrame, least: int = 10, most: int = 0) -> DataFrame:
    """Clusters of least <= size <= most; most <= 0 is no limit."""
    out = sizes.where(F.col("size") >= least)
    return out if most <= 0 else out.where(F.col("size") <= most)


def plane_distance(normal: tuple[float, float, float], d: float) -> Column:
    return F.abs(F.col("x") * normal[0] + F.col("y") * normal[1] + F.col("z") * normal[2] + d)


def plane_inliers(points: DataFrame, normal: tuple[float, float, float], d: float, threshold: float) -> DataFrame:
    """Points within the threshold (0, if negative) of the plane n p + d = 0, the border included."""
    return points.where(plane_distance(normal, d) <= max(threshold, 0.0))


def axis_distance(axis: tuple[float, float, float], center: tuple[float, float, float]) -> Column:
    """Distance from a line, by the cross product with its unit direction."""
    vx, vy, vz = (F.col(n) - c for n, c in zip(AXES, center, strict=True))
    ax, ay, az = axis
    cx, cy, cz = vy * az - vz * ay, vz * ax - vx * az, vx * ay - vy * ax
    return F.sqrt(cx * cx + cy * cy + cz * cz)


def cylinder_inliers(points: DataFrame, axis: tuple, center: tuple, radius: float, threshold: float) -> DataFrame:
    """Points within the threshold of the surface of an endless cylinder."""
    return points.where(F.abs(axis_distance(axis, center) - radius) <= max(threshold, 0.0))


def visible(points: DataFrame, index: DataFrame) -> DataFrame:
    """The rows that an index (ord) lists; an empty index lists none."""
    return points.join(index.select("ord"), "ord", "left_semi")


def removed(points: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows that are not kept."""
    return points.join(kept.select("ord"), "ord", "left_anti")


def bake(points: DataFrame, rotation: list[list[float]], translation: tuple, scale: float = 1.0) -> DataFrame:
    """Transformed coordinates s (R p) + t, computed in double and stored as float."""
    x, y, z = (F.col(n).cast("double") for n in AXES)
    moved = {n: (scale * (r[0] * x + r[1] * y + r[2] * z) + t).cast("float") for n, r, t in zip(AXES, rotation, translation, strict=True)}
    return points.withColumns(moved)


def compose(second: dict, first: dict) -> dict:
    """The transform that applies first, then second; each has rotation, translation, scale."""
    r2, r1 = second["rotation"], first["rotation"]
    rotation = [[sum(r2[i][k] * r1[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    moved = [second["scale"] * sum(r2[i][k] * first["translation"][k] for k in range(3)) + second["translation"][i] for i in range(3)]
    return {"rotation": rotation, "translation": moved, "scale": second["scale"] * first["scale"]}


NO_NORMAL, FLIP = 32768, 28672


def attach_normals(points: DataFrame, codes: DataFrame) -> DataFrame:
    """normal_code from (ord, code); rows without one have none. Codes of no row are refused."""
    if not codes.join(points, "ord", "left_anti").isEmpty():
        raise ValueError("codes name rows that the cloud does not have")
    base = points.drop("normal_code") if "normal_code" in points.columns else points
    return base.join(codes.select("ord", F.col("code").alias("normal_code")), "ord", "left").withColumn("normal_code", F.coalesce("normal_code", F.lit(NO_NORMAL)))


def invert_normals(points: DataFrame) -> DataFrame:
    """The three sign bits flip; rows without a normal stay."""
    return points.withColumn("normal_code", F.when(F.col("normal_code") != NO_NORMAL, F.col("normal_code").bitwiseXOR(F.lit(FLIP))).otherwise(F.col("normal_code")))


def clear_normals(points: DataFrame) -> DataFrame:
    return points.drop("normal_code")
