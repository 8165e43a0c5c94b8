"""Aggregates over points: boxes, histograms, moments, tree metrics, rasters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import AXES, neighbours

BINS = 256


def bbox(points: DataFrame, *by: str) -> DataFrame:
    return points.groupBy(*by).agg(*[f(n).alias(f"{f.__name__}_{n}") for n in AXES for f in (F.min, F.max)])


def class_histogram(points: DataFrame) -> DataFrame:
    return points.groupBy("classification").agg(F.count("*").alias("n")).orderBy("classification")


def bin_of(z: Column, low: Column, high: Column, bins: int = BINS) -> Column:
    """The bin of z on the axis; what lies outside goes to the end bins, an axis without span to bin 0."""
    t = (z - low) / (high - low)
    return F.when(~(high - low > 0), 0).when(t >= 1, bins - 1).when(t > 0, F.floor(t * bins)).otherwise(0).cast("int")


def elevation_histogram(points: DataFrame, bins: int = BINS) -> DataFrame:
    """(bin, n) of all bins over the cloud's z axis; NaN is skipped."""
    valid = points.select("z").where("z is not null and not isnan(z)")
    axis = valid.agg(F.min("z").alias("low"), F.max("z").alias("high"))
    counts = valid.crossJoin(F.broadcast(axis)).groupBy(bin_of(F.col("z"), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count("*").alias("n"))  # one row
    every = points.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def count_in_range(points: DataFrame, low: float, high: float, bins: int = BINS) -> DataFrame:
    """How many points lie in the bins from low's to high's."""
    valid = points.select("z").where("z is not null and not isnan(z)")
    axis = valid.agg(F.min("z").alias("low"), F.max("z").alias("high"))
    each = valid.crossJoin(F.broadcast(axis)).select(*[bin_of(c, F.col("low"), F.col("high"), bins).alias(n) for c, n in ((F.col("z"), "b"), (F.lit(low), "first"), (F.lit(high), "last"))])  # one row
    return each.agg(F.count_if(F.col("b").between(F.col("first"), F.col("last"))).alias("n"))


def normal_coverage(points: DataFrame, none: int = 32768) -> DataFrame:
    return points.agg(F.count("*").alias("total"), F.count_if(F.col("normal_code") != none).alias("computed"), F.count_if(F.coalesce("normal_code", F.lit(none)) == none).alias("missing"))


def label_sizes(labels: DataFrame) -> DataFrame:
    """(label, size) of positive labels."""
    return labels.where("label > 0").groupBy("label").agg(F.count("*").alias("size"))


def cluster_summary(labels: DataFrame, least: int = 10, most: int = 0) -> DataFrame:
    """Totals of kept and dropped clusters and points."""
    kept = (F.col("size") >= least) & (F.lit(most <= 0) | (F.col("size") <= most))
    return label_sizes(labels).agg(
        F.count("*").alias("clusters"), F.count_if(kept).alias("kept_clusters"), F.coalesce(F.sum(F.when(kept, F.col("size"))), F.lit(0)).alias("kept_points"),
        F.coalesce(F.sum(F.when(~kept, F.col("size"))), F.lit(0)).alias("dropped_points"), F.max(F.when(kept, F.col("size"))).alias("largest"),
    )


def line_summary(lines: DataFrame) -> DataFrame:
    """Lines with their length, points and gaps brought to one row."""
    return lines.agg(F.count("*").alias("lines"), F.sum("points").alias("points"), F.sum("length").alias("length"), F.max("length").alias("longest"), F.count_if(F.col("gaps") > 0).alias("with_gaps"))


def distance_stats(values: DataFrame, column: str) -> DataFrame:
    """Mean and population sigma, and the mean with sigma^2 = |E v^2 - mean^2|."""
    v = F.col(column)
    return values.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sigma"), F.abs(F.avg(v * v) - F.avg(v) * F.avg(v)).alias("sigma2"))


def moments(points: DataFrame, center: tuple = (0.0, 0.0, 0.0), third: bool = False, by: tuple = ()) -> DataFrame:
    """Count and sums of products of the coordinates about a centre, in one pass."""
    d = {n: F.col(n) - c for n, c in zip(AXES, center, strict=True)}
    names = [*AXES, "xx", "xy", "xz", "yy", "yz", "zz"] + ["xxx", "xxy", "xxz", "xyy", "xyz", "xzz", "yyy", "yyz", "yzz", "zzz"] * third

    def product(name: str) -> Column:
        out = d[name[0]]
        for n in name[1:]:
            out = out * d[n]
        return out

    return points.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(product(k)).alias(f"s{k}") for k in names])


def neighbourhood_moments(points: DataFrame, radius: float) -> DataFrame:
    """For each point with neighbours: moments of its neighbourhood about the point, itself included."""
    pairs = neighbours(points.select("ord", *AXES), radius)
    d = {n: F.col(f"b.{n}") - F.col(f"a.{n}") for n in AXES}
    names = [*AXES, "xx", "xy", "xz", "yy", "yz", "zz"]
    sums = [F.sum(d[k] if len(k) == 1 else d[k[0]] * d[k[1]]).alias(f"s{k}") for k in names]
    return pairs.groupBy(F.col("a.ord").alias("ord")).agg((F.count("*") + 1).alias("n"), *sums)


def tree_metrics(points: DataFrame, dbh_height: float = 1.3, thickness: float = 0.1, crown_ratio: float = 0.3, base_quantile: float = 0.0, *by: str) -> DataFrame:
    """Height, crown and slice of each tree (by columns, or the whole cloud), in two passes.

    The base is the lowest point, or the discrete quantile of z; the crown is what lies in
    the upper share of the height; the slice is the ring around breast height, borders
    included. Trees without a valid z have no row. The slice's centroid and least-squares
    circle come from sums; see kernels.circle for the robust fit.
    """
    clamp = lambda v, lo, hi: min(hi, max(lo, v))
    dbh_height, thickness, crown_ratio, base_quantile = clamp(dbh_height, 0, 20), clamp(thickness, 0.001, 5), clamp(crown_ratio, 0.01, 1), clamp(base_quantile, 0, 0.5)
    by = by or ("entity_id",)
    valid = points.where("z is not null and not isnan(z)")
    base = F.min("z") if base_quantile <= 0 else F.least(F.expr(f"percentile_disc({base_quantile}) within group (order by z)"), F.max("z"))
    first = valid.groupBy(*by).agg(base.alias("base_z"), F.max("z").alias("max_z"), F.min_by(F.struct("x", "y"), F.struct("z", "ord")).alias("base"))
    first = first.withColumn("height", F.col("max_z") - F.col("base_z")).withColumn("crown_z", F.col("base_z") + (1 - crown_ratio) * F.col("height"))
    low, high = F.col("base_z") + dbh_height - thickness / 2, F.col("base_z") + dbh_height + thickness / 2
    each = valid.join(first, list(by)).withColumns({"crown": F.col("z") >= F.col("crown_z"), "slice": (F.col("z") >= low) & (F.col("z") <= high)})
    crown = lambda f, n: f(F.when(F.col("crown"), F.col(n)))
    out = each.groupBy(*by).agg(
        *[F.first(k).alias(k) for k in ("height", "base_z", "crown_z")], F.first("base.x").alias("base_x"), F.first("base.y").alias("base_y"),
        (crown(F.max, "x") - crown(F.min, "x")).alias("crown_width_x"), (crown(F.max, "y") - crown(F.min, "y")).alias("crown_width_y"),
        F.count_if("crown").alias("crown_points"), F.count_if("slice").alias("slice_points"),
    )
    return out.withColumn("crown_width", F.greatest("crown_width_x", "crown_width_y")).withColumn("crown_base_height", F.col("crown_z") - F.col("base_z"))


def kasa_circle(points: DataFrame, *by: str) -> DataFrame:
    """Algebraic least-squares circle in x and y from sums about the mean: cx, cy, r; null where points are on a line."""
    mean = points.groupBy(*by).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    each = points.join(mean, list(by)) if by else points.crossJoin(F.broadcast(mean))  # one row
    u, v = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    w = u * u + v * v
    s = each.groupBy(*by).agg(F.first("mx").alias("mx"), F.first("my").alias("my"), F.count("*").alias("n"), F.sum(u * u).alias("uu"), F.sum(u * v).alias("uv"), F.sum(v * v).alias("vv"), F.sum(u * w).alias("uw"), F.sum(v * w).alias("vw"))
    det = F.expr("uu * vv - uv * uv")
    flat = F.abs(det) <= F.lit(1e-12) * F.expr("uu + vv") * F.expr("uu + vv")
    s = s.withColumns({"a": F.when(~flat, F.expr("uw * vv - vw * uv") / det / 2), "b": F.when(~flat, F.expr("vw * uu - uw * uv") / det / 2)})
    return s.select(*by, "n", (F.col("mx") + F.col("a")).alias("cx"), (F.col("my") + F.col("b")).alias("cy"), F.sqrt(F.expr("a * a + b * b + (uu + vv) / n")).alias("r"))


def percentile_rank(points: DataFrame, column: str, q: float) -> DataFrame:
    """The discrete quantile: the ceil(q n)-th value in order, the least for q = 0."""
    return points.agg(F.expr(f"percentile_disc({q}) within group (order by {column})").alias("value"))


def ground_raster(points: DataFrame, size: float = 5.0, cap: int = 1_000_000) -> tuple[DataFrame, dict]:
    """(col, row, z): the least z of each cell that has a point, and the grid's geometry.

    Cell centres lie at multiples of the size from the least x and y; the size doubles until
    the grid has no more cells than the cap.
    """
    from ..model import finite

    valid = points.where(finite("x", "y"))
    box = valid.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if box["x0"] is None:
        return valid.limit(0).select(F.lit(0).alias("col"), F.lit(0).alias("row"), F.col("z").cast("float").alias("z")), {"cols": 0, "rows": 0, "size": size, "origin": (0.0, 0.0)}
    size = size if math.isfinite(size) and size > 0 else 5.0
    while True:
        cols, rows = int((box["x1"] - box["x0"]) // size) + 1, int((box["y1"] - box["y0"]) // size) + 1
        if cols * rows <= cap:
            break
        size *= 2
    spot = lambda n, low, most: F.greatest(F.lit(0), F.least(F.lit(most - 1), F.floor((F.col(n) - low) / size + 0.5))).cast("int")
    cells = valid.where(finite("z")).groupBy(spot("x", box["x0"], cols).alias("col"), spot("y", box["y0"], rows).alias("row")).agg(F.min("z").cast("float").alias("z"))
    return cells, {"cols": cols, "rows": rows, "size": size, "origin": (box["x0"], box["y0"])}


def mode_median_argmax(values: DataFrame, by: str, column: str) -> DataFrame:
    """Mode (ties to the smallest), median (mean of the middle two) and the key of the largest count."""
    counts = values.groupBy(by, column).agg(F.count("*").alias("n"))
    mode = counts.groupBy(by).agg(F.max_by(column, F.struct("n", (-F.col(column)).alias("m"))).alias("mode"), F.sum("n").alias("n"))
    return mode.join(values.groupBy(by).agg(F.median(column).alias("median")), by)


def mean_spacing(points: DataFrame) -> DataFrame:
    """Mean distance of points from count and extents: as of a volume, a plane or a line, whichever fits."""
    b = points.agg(F.count("*").alias("n"), *[(F.max(k) - F.min(k)).alias(k) for k in AXES])
    e = F.sort_array(F.array(*AXES), asc=False)
    b = b.withColumns({"e0": e[0], "e1": e[1], "e2": e[2]})
    b = b.withColumns({"s3": F.cbrt(F.expr("e0 * e1 * e2 / n")), "s2": F.sqrt(F.expr("e0 * e1 / n")), "s1": F.expr("e0 / n")})
    return b.select(F.expr("case when n < 2 or not e0 > 0 then 1D when e1 > 0 and e2 >= s3 then s3 when e1 > 0 and e1 >= s2 then s2 when s1 > 0 then s1 else 1D end").alias("spacing"))


def pair_rms(pairs: DataFrame) -> DataFrame:
    """Root mean square of the distances of pairs (a, b); -1 for fewer than three."""
    d2 = sum(((F.col(f"a.{n}") - F.col(f"b.{n}")) * (F.col(f"a.{n}") - F.col(f"b.{n}")) for n in AXES), F.lit(0.0))
    return pairs.agg(F.when(F.count("*") >= 3, F.sqrt(F.avg(d2))).otherwise(-1.0).alias("rms"))


def extent_along(points: DataFrame, directions: dict[str, tuple]) -> DataFrame:
    """min and max of the projections on each direction: a plane's quad, a cylinder's height."""
    dot = lambda v: F.col("x") * v[0] + F.col("y") * v[1] + F.col("z") * v[2]
    return points.agg(*[f(dot(v)).alias(f"{f.__name__}_{k}") for k, v in directions.items() for f in (F.min, F.max)])


def max_class(points: DataFrame) -> DataFrame:
    return points.agg(F.max("classification").alias("max_class"))


def line_stats(points: DataFrame) -> DataFrame:
    """For each line: points, horizontal length between its ends, sag below their chord, azimuth in degrees, rms.

    Ends are the points least and most along the longer axis, ties to the smaller ord. rms
    is that of the heights about their parabola along the chord; 0 for fewer than three
    points, or where they leave the parabola undetermined.
    """
    long = points.groupBy("line").agg((F.max("x") - F.min("x") >= F.max("y") - F.min("y")).alias("by_x"))
    each = points.join(long, "line").withColumn("t", F.when(F.col("by_x"), F.col("x")).otherwise(F.col("y")))
    key = lambda s: F.struct((F.col("t") * s).alias("t"), "ord")
    ends = each.groupBy("line").agg(F.min_by(F.struct(*AXES), key(1)).alias("p"), F.min_by(F.struct(*AXES), key(-1)).alias("q"))
    ends = ends.withColumns({"dx": F.col("q.x") - F.col("p.x"), "dy": F.col("q.y") - F.col("p.y")}).withColumn("length", F.sqrt(F.expr("dx * dx + dy * dy")))
    each = points.join(ends, "line")
    along = F.when(F.col("length") > 0, ((F.col("x") - F.col("p.x")) * F.col("dx") + (F.col("y") - F.col("p.y")) * F.col("dy")) / (F.col("length") * F.col("length"))).otherwise(0.0)
    chord = F.col("p.z") + along * (F.col("q.z") - F.col("p.z"))
    each = each.withColumns({"v": 2 * along - 1, "h": F.col("z") - F.col("p.z")})
    powers = [F.avg(F.pow("v", F.lit(k))).alias(f"v{k}") for k in range(1, 5)] + [F.avg(F.col("h") * F.pow("v", F.lit(k))).alias(f"h{k}") for k in range(3)] + [F.avg(F.col("h") * F.col("h")).alias("hh")]
    told = each.groupBy("line").agg(F.count("*").alias("points"), F.first("length").alias("length"), F.greatest(F.lit(0.0), F.max(chord - F.col("z"))).alias("sag"), F.pmod(F.degrees(F.atan2(F.first("dx"), F.first("dy"))), F.lit(180.0)).alias("azimuth"), *powers)
    # h = a v^2 + b v + c by least squares: Cramer's rule on the normal equations.
    m = [["v4", "v3", "v2"], ["v3", "v2", "v1"], ["v2", "v1", None]]
    at = lambda n: F.lit(1.0) if n is None else F.col(n)

    def det(rows) -> Column:
        (a, b, c), (d, e, f), (g, h, i) = ([at(n) for n in r] for r in rows)
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    whole, right = det(m), ["h2", "h1", "h0"]
    a, b, c = (det([[*r[:k], right[j], *r[k + 1 :]] for j, r in enumerate(m)]) / F.col("det") for k in range(3))
    told = told.withColumn("det", whole).withColumns({"a": F.when(F.abs("det") > 1e-12, a), "b": F.when(F.abs("det") > 1e-12, b), "c": F.when(F.abs("det") > 1e-12, c)})
    # The mean square of what is left is that of h less its product with the fitted heights.
    left = F.col("hh") - F.col("a") * F.col("h2") - F.col("b") * F.col("h1") - F.col("c") * F.col("h0")
    return told.select("line", "points", "length", "sag", "azimuth", F.when(F.col("points") >= 3, F.coalesce(F.sqrt(F.greatest(F.lit(0.0), left)), F.lit(0.0))).otherwise(0.0).alias("rms"))


def running_split(points: DataFrame, by: str, column: str, gap: float) -> DataFrame:
    """points with part: a new part begins where column jumps by more than the gap."""
    w = Window.partitionBy(by).orderBy(column, "ord")
    jump = (F.col(column) - F.lag(column).over(w) > gap).cast("int")
    return points.withColumn("__j", F.coalesce(jump, F.lit(0))).withColumn("part", F.sum("__j").over(w)).drop("__j")
