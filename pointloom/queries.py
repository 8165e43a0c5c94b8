"""The queries of the point-cloud operators, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model as M
from .functions import colour as C
from .functions import measure as S
from .operators import aggregates as A
from .operators import clustering as G
from .operators import entities as E
from .operators import filters as L
from .operators import joins as J

EMB = "cloud AS (SELECT vec_id AS ord, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(label AS INTEGER) AS classification FROM embeddings)"
LINE = "cloud AS (SELECT l_quantity AS x, l_extendedprice / 2000 AS y, l_discount * 100 AS z, CAST(l_linenumber AS INTEGER) AS classification FROM lineitem)"
EVT = "cloud AS (SELECT event_id AS ord, CAST(user_id % 20 AS INTEGER) AS entity_id, CAST(user_id AS DOUBLE) AS x, CAST(event_id % 24 AS DOUBLE) AS y, value AS z, CASE event_type WHEN 'click' THEN 4 WHEN 'view' THEN 5 ELSE 2 END AS classification FROM events)"
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
#: A perspective looking down the z axis from 2, column by column, and an orthographic one.
EYE = [1.5, 0.0, 0.0, 0.0, 0.0, 1.5, 0.0, 0.0, 0.0, 0.0, -1.0, -1.0, 0.0, 0.0, 1.8, 2.0]
FLAT = [2.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, -4.0, 0.0, 0.0, 0.0, 0.0, 1.0]
STAR = [(-0.4, -0.3), (0.5, -0.4), (0.1, 0.0), (0.45, 0.4), (-0.1, 0.15), (-0.35, 0.45)]

_all: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        _all[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all.items() if s}


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def spread(struct: Column, *names: str) -> list[Column]:
    return [struct[n].alias(n) for n in names]


# Filters


@query(f"WITH {EMB} SELECT a.ord FROM cloud a JOIN cloud b ON a.ord <> b.ord AND {D2} <= 0.06 * 0.06 GROUP BY a.ord HAVING count(*) >= 2")
def f1_radius_filter(spark, d):
    return L.radius_filter(M.cloud_emb(spark, d), 0.06, 2).select("ord")


@query(f"WITH {EMB}, near AS (SELECT a.ord, {D2} AS d2, row_number() OVER (PARTITION BY a.ord ORDER BY {D2}, b.ord) AS r FROM cloud a JOIN cloud b ON a.ord <> b.ord), m AS (SELECT ord, avg(d2) AS m FROM near WHERE r <= 5 GROUP BY ord) SELECT ord FROM m WHERE m <= (SELECT avg(m) + stddev_pop(m) FROM m)")
def f2_statistical_filter(spark, d):
    return L.statistical_filter(M.cloud_emb(spark, d), 5, 1.0, 0.15).select("ord")


@query(f"WITH {EMB}, c AS (SELECT *, floor(x / 0.1) AS cx, floor(y / 0.1) AS cy, floor(z / 0.1) AS cz FROM cloud), m AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my, avg(z) OVER w AS mz FROM c WINDOW w AS (PARTITION BY cx, cy, cz)) SELECT ord FROM m QUALIFY row_number() OVER (PARTITION BY cx, cy, cz ORDER BY round((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz), 12), ord) = 1")
def f3_voxel_downsample(spark, d):
    return L.voxel_downsample(M.cloud_emb(spark, d), 0.1, 12).select("ord")


@query(f"WITH {EMB} SELECT ord, 2 - z > 0 AND 1.5 * x / (2 - z) BETWEEN -0.1 AND 0.12 AND 1.5 * y / (2 - z) BETWEEN -0.15 AND 0.1 AS inside FROM cloud")
def f4_rectangle_selection(spark, d):
    return L.rectangle_selection(M.cloud_emb(spark, d), EYE, (-0.1, -0.15, 0.12, 0.1)).select("ord", "inside")


@query(f"WITH {EMB} SELECT ord, -4 * z BETWEEN -1 AND 1 AND 2 * x BETWEEN -0.2 AND 0.3 AND 2 * y BETWEEN -0.3 AND 0.2 AS inside FROM cloud")
def f4_rectangle_selection_orthographic(spark, d):
    return L.rectangle_selection(M.cloud_emb(spark, d), FLAT, (-0.2, -0.3, 0.3, 0.2), orthographic=True).select("ord", "inside")


def _polygon_sql() -> str:
    terms = []
    for (xi, yi), (xj, yj) in zip(STAR, [STAR[-1], *STAR[:-1]], strict=True):
        terms.append(f"CASE WHEN (CAST({yi} AS DOUBLE) > ny) <> (CAST({yj} AS DOUBLE) > ny) AND nx < CAST({xj - xi!r} AS DOUBLE) * (ny - CAST({yi} AS DOUBLE)) / CAST({yj - yi!r} AS DOUBLE) + CAST({xi} AS DOUBLE) THEN 1 ELSE 0 END")
    return f"WITH {EMB}, p AS (SELECT ord, 2 * x AS nx, 2 * y AS ny, -4 * z AS zc FROM cloud) SELECT ord, zc BETWEEN -1 AND 1 AND ({' + '.join(terms)}) % 2 = 1 AS inside FROM p"


@query(_polygon_sql())
def f5_polygon_selection(spark, d):
    return L.polygon_selection(M.cloud_emb(spark, d), FLAT, STAR, orthographic=True).select("ord", "inside")


@query(f"WITH {LINE} SELECT classification, CAST(dense_rank() OVER (ORDER BY classification) AS INTEGER) AS label, count(*) AS n FROM cloud GROUP BY classification")
def f6_split_by_class(spark, d):
    return L.split_by_class(M.cloud_line(spark, d)).groupBy("classification", "label").agg(F.count("*").alias("n"))


@query(f"WITH {EMB} SELECT ord, CASE WHEN z > 0 THEN 6 ELSE classification END AS classification FROM cloud")
def f7_set_class(spark, d):
    return L.set_class(M.cloud_emb(spark, d), 6, F.col("z") > 0).select("ord", "classification")


@query(f"WITH {EVT} SELECT entity_id, bool_and(classification IN (4, 5)) AS is_tree FROM cloud GROUP BY entity_id")
def f11_tree_predicate(spark, d):
    return L.is_tree(M.cloud_evt(spark, d))


@query(f"WITH {EMB} SELECT classification AS label, count(*) AS size FROM cloud WHERE classification > 0 GROUP BY 1 HAVING count(*) BETWEEN 10 AND 55")
def f12_kept_clusters(spark, d):
    return L.kept_clusters(A.label_sizes(M.cloud_emb(spark, d).withColumn("label", F.col("classification"))), 10, 55)


@query(f"WITH {EMB} SELECT ord FROM cloud WHERE abs(x * 0.6 + y * 0.0 + z * 0.8 + 0.01) <= 0.05")
def f13_plane_inliers(spark, d):
    return L.plane_inliers(M.cloud_emb(spark, d), (0.6, 0.0, 0.8), 0.01, 0.05).select("ord")


@query(f"WITH {EMB} SELECT ord FROM cloud WHERE abs(sqrt((x - 0.01) * (x - 0.01) + (y + 0.02) * (y + 0.02)) - 0.15) <= 0.04")
def f14_cylinder_inliers(spark, d):
    return L.cylinder_inliers(M.cloud_emb(spark, d), (0.0, 0.0, 1.0), (0.01, -0.02, 0.0), 0.15, 0.04).select("ord")


@query(f"WITH {EMB} SELECT ord, x, y, z FROM cloud WHERE ord IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def f15_visible_index(spark, d):
    cloud = M.cloud_emb(spark, d)
    return L.visible(cloud, cloud.where("classification = 3")).select("ord", "x", "y", "z")


@query(f"WITH {EMB} SELECT ord, CAST(2.0 * (0.0 * x - 1.0 * y + 0.0 * z) + 1.5 AS FLOAT) AS x, CAST(2.0 * (1.0 * x + 0.0 * y + 0.0 * z) - 0.5 AS FLOAT) AS y, CAST(2.0 * (0.0 * x + 0.0 * y + 1.0 * z) + 0.25 AS FLOAT) AS z FROM cloud")
def f16_bake_transform(spark, d):
    return L.bake(M.cloud_emb(spark, d), [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], (1.5, -0.5, 0.25), 2.0).select("ord", "x", "y", "z")


@query(f"WITH {EMB} SELECT ord, round(-2 * (x + 1) + 0.5, 6) AS x, round(-2 * y, 6) AS y, round(2 * z, 6) AS z FROM cloud")
def f17_compose_transforms(spark, d):
    shift = {"rotation": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "translation": (1.0, 0.0, 0.0), "scale": 1.0}
    turn = {"rotation": [[-1, 0, 0], [0, -1, 0], [0, 0, 1]], "translation": (0.5, 0.0, 0.0), "scale": 2.0}
    both = L.compose(turn, shift)
    x, y, z = (F.col(n) for n in "xyz")
    moved = [r6(both["scale"] * (r[0] * x + r[1] * y + r[2] * z) + t).alias(n) for n, r, t in zip("xyz", both["rotation"], both["translation"], strict=True)]
    return M.cloud_emb(spark, d).select("ord", *moved)


@query(f"WITH {EMB} SELECT ord, CASE WHEN ord % 3 = 0 THEN CAST(ord % 32768 AS INTEGER) ELSE 32768 END AS normal_code FROM cloud")
def f18_attach_normals(spark, d):
    cloud = M.cloud_emb(spark, d)
    codes = cloud.where("ord % 3 = 0").select("ord", (F.col("ord") % 32768).cast("int").alias("code"))
    return L.attach_normals(cloud, codes).select("ord", "normal_code")


@query(f"WITH {EMB} SELECT ord, CASE WHEN ord % 3 = 0 THEN xor(CAST(ord % 32768 AS INTEGER), 28672) ELSE 32768 END AS normal_code FROM cloud")
def f19_invert_normals(spark, d):
    cloud = M.cloud_emb(spark, d).withColumn("normal_code", F.when(F.col("ord") % 3 == 0, (F.col("ord") % 32768).cast("int")).otherwise(32768))
    return L.invert_normals(cloud).select("ord", "normal_code")


# Joins


@query(f"WITH {EMB} SELECT a.ord AS a, b.ord AS b, round({D2}, 9) AS d2 FROM cloud a JOIN cloud b ON a.ord < b.ord AND {D2} <= 0.08 * 0.08")
def j1_range_join(spark, d):
    return J.range_pairs(M.cloud_emb(spark, d), 0.08).select(F.col("a.ord").alias("a"), F.col("b.ord").alias("b"), F.round("d2", 9).alias("d2"))


@query(f"WITH {EMB} SELECT * FROM (SELECT a.ord AS a, b.ord AS b, CAST(row_number() OVER (PARTITION BY a.ord ORDER BY {D2}, b.ord) AS INTEGER) AS rank FROM cloud a JOIN cloud b ON a.ord <> b.ord) WHERE rank <= 4")
def j2_knn_join(spark, d):
    cloud = M.cloud_emb(spark, d)
    return J.knn_join(cloud, cloud, 4, 0.12).select(F.col("a.ord").alias("a"), F.col("b.ord").alias("b"), "rank")


@query(f"WITH {EMB} SELECT a, b FROM (SELECT a.ord AS a, b.ord AS b, row_number() OVER (PARTITION BY a.ord ORDER BY {D2}, b.ord) AS r FROM cloud a JOIN cloud b ON a.ord % 2 = 0 AND b.ord % 2 = 1) WHERE r = 1")
def j3_nearest_join(spark, d):
    cloud = M.cloud_emb(spark, d)
    return J.nearest_join(cloud.where("ord % 2 = 0"), cloud.where("ord % 2 = 1"), 0.12).select(F.col("a.ord").alias("a"), F.col("b.ord").alias("b"))


@query(f"WITH {EMB} SELECT ord, CAST(classification % 4 AS INTEGER) AS label FROM cloud WHERE ord % 2 = 0")
def j4_label_join(spark, d):
    cloud = M.cloud_emb(spark, d)
    return E.split_many(cloud, cloud.where("ord % 2 = 0").select("ord", (F.col("classification") % 4).alias("label"))).select("ord", "label")


@query(f"WITH {EMB} SELECT a.ord FROM cloud a WHERE NOT EXISTS (SELECT 1 FROM cloud b WHERE a.ord <> b.ord AND {D2} <= 0.06 * 0.06)")
def j5_removed_by_filter(spark, d):
    cloud = M.cloud_emb(spark, d)
    return L.removed(cloud, L.radius_filter(cloud, 0.06, 1)).select("ord")


@query(f"WITH {EMB}, u AS (SELECT *, CASE WHEN ord % 5 = 0 THEN NULL ELSE x / sqrt(x * x + y * y + z * z) END AS dx, y / sqrt(x * x + y * y + z * z) AS dy, z / sqrt(x * x + y * y + z * z) AS dz FROM cloud) SELECT a.ord AS a, b.ord AS b FROM u a JOIN u b ON a.ord < b.ord AND {D2} <= 0.1 * 0.1 AND (a.dx IS NULL OR b.dx IS NULL OR abs(a.dx * b.dx + a.dy * b.dy + a.dz * b.dz) >= cos(radians(15)))")
def j7_angle_gated_join(spark, d):
    n = F.sqrt(F.expr("x * x + y * y + z * z"))
    cloud = M.cloud_emb(spark, d).withColumns({"dx": F.when(F.col("ord") % 5 != 0, F.col("x") / n), "dy": F.col("y") / n, "dz": F.col("z") / n})
    return J.angle_gated_pairs(cloud, 0.1, 15.0).select(F.col("a.ord").alias("a"), F.col("b.ord").alias("b"))


@query(f"WITH {EMB}, n AS (SELECT *, row_number() OVER (PARTITION BY classification ORDER BY ord) AS i FROM cloud) SELECT a.i AS index, a.ord AS a, b.ord AS b FROM n a JOIN n b ON a.i = b.i AND a.classification = 1 AND b.classification = 2")
def j9_point_pairs(spark, d):
    from pyspark.sql import Window

    n = M.cloud_emb(spark, d).withColumn("index", F.row_number().over(Window.partitionBy("classification").orderBy("ord")).cast("long"))
    return J.point_pairs(n.where("classification = 1"), n.where("classification = 2")).select("index", F.col("a.ord").alias("a"), F.col("b.ord").alias("b"))


@query(f"WITH {EMB} SELECT ord, round(z + 1, 6) AS depth FROM cloud WHERE z >= -1 AND x * x + y * y <= 0.05 * 0.05 ORDER BY z, ord LIMIT 1")
def j10_ray_pick(spark, d):
    return J.ray_pick(M.cloud_emb(spark, d), (0.0, 0.0, -1.0), (0.0, 0.0, 2.0), 0.05).select("ord", r6("depth").alias("depth"))


# Aggregates


@query(f"WITH {LINE} SELECT classification, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM cloud GROUP BY classification")
def a1_bbox(spark, d):
    return A.bbox(M.cloud_line(spark, d), "classification")


@query(f"WITH {LINE} SELECT classification, count(*) AS n FROM cloud GROUP BY classification")
def a2_class_histogram(spark, d):
    return A.class_histogram(M.cloud_line(spark, d))


BIN = "CASE WHEN NOT (hi - lo > 0) THEN 0 WHEN (z - lo) / (hi - lo) >= 1 THEN 255 WHEN (z - lo) / (hi - lo) > 0 THEN floor((z - lo) / (hi - lo) * 256) ELSE 0 END"


@query(f"WITH {EMB}, h AS (SELECT CAST({BIN} AS INTEGER) AS bin, count(*) AS n FROM cloud, (SELECT min(z) AS lo, max(z) AS hi FROM cloud) GROUP BY 1) SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(256) t(i) LEFT JOIN h ON i = bin")
def a3_elevation_histogram(spark, d):
    return A.elevation_histogram(M.cloud_emb(spark, d))


@query(f"WITH {EMB}, b AS (SELECT min(z) AS lo, max(z) AS hi FROM cloud) SELECT count(*) AS n FROM cloud, b WHERE {BIN} BETWEEN floor((-0.1 - lo) / (hi - lo) * 256) AND floor((0.2 - lo) / (hi - lo) * 256)")
def a4_count_in_range(spark, d):
    return A.count_in_range(M.cloud_emb(spark, d), -0.1, 0.2)


@query(f"WITH {EMB} SELECT count(*) AS total, count(*) FILTER (ord % 3 = 0) AS computed, count(*) FILTER (ord % 3 <> 0) AS missing FROM cloud")
def a5_normal_coverage(spark, d):
    return A.normal_coverage(f18_attach_normals(spark, d))


@query(f"WITH {EMB}, s AS (SELECT classification, count(*) AS size FROM cloud WHERE classification > 0 GROUP BY 1) SELECT count(*) AS clusters, count(*) FILTER (size >= 50) AS kept_clusters, CAST(coalesce(sum(size) FILTER (size >= 50), 0) AS BIGINT) AS kept_points, CAST(coalesce(sum(size) FILTER (size < 50), 0) AS BIGINT) AS dropped_points, max(size) FILTER (size >= 50) AS largest FROM s")
def a6_cluster_summary(spark, d):
    return A.cluster_summary(M.cloud_emb(spark, d).withColumn("label", F.col("classification")), 50)


@query(f"WITH {EVT}, s AS (SELECT entity_id, count(*) AS size FROM cloud WHERE entity_id > 0 GROUP BY 1) SELECT CAST(entity_id AS INTEGER) AS label, size FROM s")
def a7_tree_label_counts(spark, d):
    return A.label_sizes(M.cloud_evt(spark, d).withColumn("label", F.col("entity_id")))


@query(f"WITH {EVT}, l AS (SELECT entity_id, count(*) AS points, max(y) - min(y) AS length, entity_id % 3 AS gaps FROM cloud GROUP BY entity_id) SELECT count(*) AS lines, CAST(sum(points) AS BIGINT) AS points, sum(length) AS length, max(length) AS longest, count(*) FILTER (gaps > 0) AS with_gaps FROM l")
def a8_line_summary(spark, d):
    lines = M.cloud_evt(spark, d).groupBy("entity_id").agg(F.count("*").alias("points"), (F.max("y") - F.min("y")).alias("length"), (F.first("entity_id") % 3).alias("gaps"))
    return A.line_summary(lines)


@query(f"WITH {EMB} SELECT round(avg(z * z), 6) AS mean, round(stddev_pop(z * z), 6) AS sigma, round(abs(avg(z * z * z * z) - avg(z * z) * avg(z * z)), 6) AS sigma2 FROM cloud")
def a9_distance_stats(spark, d):
    return A.distance_stats(M.cloud_emb(spark, d).withColumn("d2", F.col("z") * F.col("z")), "d2").select(*[r6(c).alias(c) for c in ("mean", "sigma", "sigma2")])


@query(f"WITH {EMB} SELECT round(abs(avg(x * x) - avg(x) * avg(x)), 6) AS sigma2, round(avg(x), 6) AS mean FROM cloud")
def a10_mean_sigma(spark, d):
    return A.distance_stats(M.cloud_emb(spark, d), "x").select(r6("sigma2").alias("sigma2"), r6("mean").alias("mean"))


@query(f"WITH {EMB} SELECT classification, count(*) AS n, " + ", ".join(f"round(sum({'*'.join(k)}), 6) AS s{k}" for k in ("x", "y", "z", "xx", "xy", "xz", "yy", "yz", "zz", "xxx", "xxy", "xxz", "xyy", "xyz", "xzz", "yyy", "yyz", "yzz", "zzz")) + " FROM cloud GROUP BY classification")
def a11_moments(spark, d):
    m = A.moments(M.cloud_emb(spark, d), third=True, by=("classification",))
    return m.select("classification", "n", *[r6(c).alias(c) for c in m.columns if c.startswith("s")])


@query(f"WITH {EMB} SELECT a.ord, count(*) + 1 AS n, " + ", ".join(f"round(sum({'*'.join(f'(b.{c} - a.{c})' for c in k)}), 6) AS s{k}" for k in ("x", "y", "z", "xx", "xy", "xz", "yy", "yz", "zz")) + f" FROM cloud a JOIN cloud b ON a.ord <> b.ord AND {D2} <= 0.1 * 0.1 GROUP BY a.ord")
def a12_neighbourhood_moments(spark, d):
    m = A.neighbourhood_moments(M.cloud_emb(spark, d), 0.1)
    return m.select("ord", "n", *[r6(c).alias(c) for c in m.columns if c.startswith("s")])


@query(f"WITH {EVT}, f AS (SELECT entity_id, min(z) AS base_z, max(z) AS max_z, max(z) - min(z) AS height, arg_min(x, (z, ord)) AS base_x, arg_min(y, (z, ord)) AS base_y FROM cloud GROUP BY 1), e AS (SELECT c.*, base_z, height, base_x, base_y, base_z + (1 - 0.3) * height AS crown_z FROM cloud c JOIN f USING (entity_id)) SELECT entity_id, round(any_value(height), 6) AS height, any_value(base_x) AS base_x, any_value(base_y) AS base_y, max(x) FILTER (z >= crown_z) - min(x) FILTER (z >= crown_z) AS crown_width_x, max(y) FILTER (z >= crown_z) - min(y) FILTER (z >= crown_z) AS crown_width_y, count(*) FILTER (z >= crown_z) AS crown_points, count(*) FILTER (z >= base_z + 1.3 - 0.5 / 2 AND z <= base_z + 1.3 + 0.5 / 2) AS slice_points FROM e GROUP BY 1")
def a13_tree_metrics(spark, d):
    return A.tree_metrics(M.cloud_evt(spark, d), 1.3, 0.5).select("entity_id", r6("height").alias("height"), "base_x", "base_y", "crown_width_x", "crown_width_y", "crown_points", "slice_points")


@query(f"WITH {EVT} SELECT quantile_disc(z, 0.05) AS value FROM cloud")
def a14_discrete_quantile(spark, d):
    return A.percentile_rank(M.cloud_evt(spark, d), "z", 0.05)


@query(f"WITH {EMB}, m AS (SELECT classification, avg(x) AS mx, avg(y) AS my FROM cloud GROUP BY 1), e AS (SELECT classification, mx, my, x - mx AS u, y - my AS v FROM cloud JOIN m USING (classification)), s AS (SELECT classification, any_value(mx) AS mx, any_value(my) AS my, count(*) AS n, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * (u * u + v * v)) AS uw, sum(v * (u * u + v * v)) AS vw FROM e GROUP BY 1), f AS (SELECT *, (uw * vv - vw * uv) / (uu * vv - uv * uv) / 2 AS a, (vw * uu - uw * uv) / (uu * vv - uv * uv) / 2 AS b FROM s) SELECT classification, n, round(mx + a, 6) AS cx, round(my + b, 6) AS cy, round(sqrt(a * a + b * b + (uu + vv) / n), 6) AS r FROM f")
def a15_kasa_circle(spark, d):
    return A.kasa_circle(M.cloud_emb(spark, d), "classification").select("classification", "n", r6("cx").alias("cx"), r6("cy").alias("cy"), r6("r").alias("r"))


@query(f"WITH {EMB}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cloud), g AS (SELECT *, floor((x1 - x0) / 0.1) AS mc, floor((y1 - y0) / 0.1) AS mr FROM b) SELECT CAST(greatest(0, least(mc, floor((x - x0) / 0.1 + 0.5))) AS INTEGER) AS col, CAST(greatest(0, least(mr, floor((y - y0) / 0.1 + 0.5))) AS INTEGER) AS row, CAST(min(z) AS FLOAT) AS z FROM cloud, g GROUP BY 1, 2")
def a16_ground_raster(spark, d):
    return A.ground_raster(M.cloud_emb(spark, d), 0.1)[0]


@query("SELECT l_linenumber AS k, mode AS mode, n, median FROM (SELECT l_linenumber, CAST(sum(c) AS BIGINT) AS n, arg_max(q, c * 1000 - q) AS mode FROM (SELECT l_linenumber, l_quantity AS q, count(*) AS c FROM lineitem GROUP BY 1, 2) GROUP BY 1) JOIN (SELECT l_linenumber, median(l_quantity) AS median FROM lineitem GROUP BY 1) USING (l_linenumber)")
def a18_mode_median(spark, d):
    rows = M.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("v"))
    return A.mode_median_argmax(rows, "k", "v").select("k", "mode", "n", "median")


@query(f"WITH {EMB}, b AS (SELECT count(*) AS n, max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(z) - min(z) AS ez FROM cloud) SELECT round(cbrt(ex * ey * ez / n), 6) AS spacing FROM b")
def a19_mean_spacing(spark, d):
    return A.mean_spacing(M.cloud_emb(spark, d)).select(r6("spacing").alias("spacing"))


@query(f"WITH {EVT} SELECT entity_id AS line, count(*) AS points FROM cloud GROUP BY 1")
def a20_line_stats_points(spark, d):
    return A.line_stats(M.cloud_evt(spark, d).withColumnRenamed("entity_id", "line")).select("line", "points")


@query(f"WITH {EMB}, n AS (SELECT *, row_number() OVER (PARTITION BY classification ORDER BY ord) AS i FROM cloud) SELECT round(sqrt(avg({D2})), 6) AS rms FROM n a JOIN n b ON a.i = b.i AND a.classification = 1 AND b.classification = 2")
def a21_pair_rms(spark, d):
    from pyspark.sql import Window

    n = M.cloud_emb(spark, d).withColumn("index", F.row_number().over(Window.partitionBy("classification").orderBy("ord")))
    return A.pair_rms(J.point_pairs(n.where("classification = 1"), n.where("classification = 2"))).select(r6("rms").alias("rms"))


@query(f"WITH {EMB} SELECT round(min(x * 0.6 + y * 0.8), 6) AS min_u, round(max(x * 0.6 + y * 0.8), 6) AS max_u, round(min(y * 0.6 - x * 0.8), 6) AS min_v, round(max(y * 0.6 - x * 0.8), 6) AS max_v FROM cloud")
def a22_plane_extent(spark, d):
    found = A.extent_along(M.cloud_emb(spark, d), {"u": (0.6, 0.8, 0.0), "v": (-0.8, 0.6, 0.0)})
    return found.select(*[r6(c).alias(c) for c in found.columns])


@query(f"WITH {LINE} SELECT max(classification) AS max_class FROM cloud")
def a23_max_class(spark, d):
    return A.max_class(M.cloud_line(spark, d))


@query(f"WITH {EVT}, j AS (SELECT *, CASE WHEN z - lag(z) OVER (PARTITION BY entity_id ORDER BY z, ord) > 0.3 THEN 1 ELSE 0 END AS j FROM cloud), p AS (SELECT entity_id, ord, sum(j) OVER (PARTITION BY entity_id ORDER BY z, ord ROWS UNBOUNDED PRECEDING) AS part FROM j) SELECT entity_id, CAST(part AS BIGINT) AS part, count(*) AS n FROM p GROUP BY 1, 2")
def w1_gap_split(spark, d):
    return A.running_split(M.cloud_evt(spark, d), "entity_id", "z", 0.3).groupBy("entity_id", "part").agg(F.count("*").alias("n"))


@query(f"WITH {EMB}, n AS (SELECT *, row_number() OVER (ORDER BY ord) AS i FROM cloud) SELECT ord FROM n WHERE (i - 1) % 7 = 0")
def g18_equal_stride(spark, d):
    cloud = M.cloud_emb(spark, d)
    return cloud.join(G.numbered(cloud, "ord", "i"), "ord").where("(i - 1) % 7 = 0").select("ord")


# Entities


def _entities(spark, d):
    return M.cloud_emb(spark, d).withColumn("entity_id", F.col("classification"))


@query(f"WITH {EMB}, s AS (SELECT classification AS e, max(ord) + 1 AS n FROM cloud WHERE classification IN (1, 2, 3) GROUP BY 1) SELECT 99 AS entity_id, CAST(c.ord + CASE c.classification WHEN 3 THEN 0 WHEN 1 THEN (SELECT n FROM s WHERE e = 3) ELSE (SELECT sum(n) FROM s WHERE e IN (3, 1)) END AS BIGINT) AS ord, c.x FROM cloud c WHERE classification IN (1, 2, 3)")
def e1_merge(spark, d):
    return E.merge(_entities(spark, d), [3, 1, 3, 2], 99).select("entity_id", "ord", "x")


@query(f"WITH {EMB} SELECT ord, CASE WHEN z > 0 THEN '.ground' ELSE '.offGround' END AS product FROM cloud")
def e2_split(spark, d):
    return E.split(M.cloud_emb(spark, d), F.col("z") > 0, (".ground", ".offGround")).select("ord", "product")


@query(f"WITH {EMB} SELECT classification % 3 + 1 AS label, count(*) AS n FROM cloud WHERE ord % 4 <> 0 GROUP BY 1")
def e3_split_many(spark, d):
    cloud = M.cloud_emb(spark, d)
    parts = cloud.where("ord % 4 <> 0").select("ord", (F.col("classification") % 3 + 1).alias("label"))
    return E.split_many(cloud, parts).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {EMB}, k AS (SELECT classification FROM cloud WHERE classification > 0 GROUP BY 1 HAVING count(*) >= 50) SELECT ord, CASE WHEN classification IN (SELECT * FROM k) THEN classification ELSE 0 END AS bucket FROM cloud")
def e4_label_buckets(spark, d):
    cloud = M.cloud_emb(spark, d)
    labels = cloud.select("ord", F.col("classification").alias("label"))
    return E.buckets(cloud, labels, L.kept_clusters(A.label_sizes(labels), 50)).select("ord", "bucket")


@query(f"WITH {EMB} SELECT ord FROM cloud WHERE classification NOT IN (1, 2)")
def e5_residual(spark, d):
    cloud = M.cloud_emb(spark, d)
    return E.residual(cloud, cloud.where("classification = 1").unionByName(cloud.where("classification = 2"))).select("ord")


@query(f"WITH {EMB} SELECT CASE WHEN classification < 4 THEN 1 ELSE 2 END AS group_id, classification AS entity_id, count(*) AS n FROM cloud WHERE classification < 6 GROUP BY 1, 2")
def e6_container_union(spark, d):
    groups = spark.createDataFrame([(1, [0, 1, 2, 3]), (2, [4, 5])], "group_id int, entity_ids array<int>")
    return E.container_labels(_entities(spark, d), groups).groupBy("group_id", "entity_id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT CAST(label AS INTEGER) AS label FROM embeddings WHERE label > 0")
def e7_guarded_labels(spark, d):
    return E.guard(M.cloud_emb(spark, d).where("classification > 0").select(F.col("classification").alias("label")).distinct(), 2000, "clusters")


@query("SELECT CAST(i AS INTEGER) AS i, [CASE WHEN starts_with(l, 'Tree ') OR l = 'Tree' THEN 'Tree ' || (i + 9) ELSE l END || CASE WHEN i % 2 = 0 THEN '' ELSE ' (' || i || '+' || (i + 1) || ')' END][1] AS name FROM (SELECT i, ['Tree 3', 'Treetop', 'plot.las', 'Tree'][i % 4 + 1] AS l FROM range(8) t(i))")
def e8_merged_name(spark, d):
    i = F.col("id").cast("int")
    lead = F.element_at(F.array(*[F.lit(x) for x in ("Tree 3", "Treetop", "plot.las", "Tree")]), (i % 4 + 1).cast("int"))
    numbers = F.when(i % 2 == 0, F.array().cast("array<int>")).otherwise(F.array(i, i + 1))
    return spark.range(8).select(i.alias("i"), E.merged_name(lead, numbers, i + 9).alias("name"))


@query(f"WITH {EMB} SELECT classification AS entity_id, count(*) AS n FROM cloud WHERE classification NOT IN (2, 5) GROUP BY 1")
def e9_delete_entities(spark, d):
    return E.delete_entities(_entities(spark, d), [2, 5]).groupBy("entity_id").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey AS group_id, n_nationkey AS label, CAST(5 * n_regionkey + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS label_no FROM nation")
def e10_number_products(spark, d):
    existing = M.table(spark, d, "region").select(F.col("r_regionkey").alias("group_id"), (F.col("r_regionkey") * 5).cast("int").alias("label_no"))
    products = M.table(spark, d, "nation").select(F.col("n_regionkey").alias("group_id"), F.col("n_nationkey").alias("label"))
    return E.number_products(existing, products).select("group_id", "label", F.col("label_no").cast("int").alias("label_no"))


@query("SELECT n_regionkey AS group_id, CAST(count(*) + CASE n_regionkey WHEN 1 THEN 1 WHEN 0 THEN -1 ELSE 0 END AS INTEGER) AS members FROM nation GROUP BY n_regionkey")
def e11_move_member(spark, d):
    nation = M.table(spark, d, "nation")
    groups = nation.groupBy(F.col("n_regionkey").alias("group_id")).agg(F.array_sort(F.collect_list("n_nationkey")).alias("entity_ids"))
    first = nation.where("n_regionkey = 0").agg(F.min("n_nationkey")).first()[0]
    return E.move(groups, first, 1).select("group_id", F.size("entity_ids").alias("members"))


@query(f"WITH {EVT} SELECT entity_id, round(max(z) - min(z), 6) AS height FROM cloud GROUP BY 1")
def e12_attach_metrics(spark, d):
    cloud = M.cloud_evt(spark, d)
    entities = cloud.select("entity_id").distinct().withColumn("tree_object", F.lit(None).cast("struct<height:double>"))
    return E.attach(entities, A.tree_metrics(cloud).select("entity_id", "height")).select("entity_id", r6("tree_object.height").alias("height"))


@query("SELECT r_regionkey AS entity_id, r_name AS name, CASE r_regionkey WHEN 3 THEN 0 ELSE 1 END AS place FROM region WHERE r_regionkey IN (1, 3)")
def e13_pair(spark, d):
    entities = M.table(spark, d, "region").select(F.col("r_regionkey").alias("entity_id"), F.col("r_name").alias("name"))
    found = E.pair(entities, [3, 1])
    return spark.createDataFrame([(r["entity_id"], r["name"], k) for k, r in enumerate(found)], "entity_id int, name string, place int")


# Clustering


@query(f"WITH RECURSIVE {EMB}, e AS (SELECT a.ord AS a, b.ord AS b FROM cloud a JOIN cloud b ON {D2} <= 0.07 * 0.07), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), m AS (SELECT a AS ord, min(b) AS root FROM r GROUP BY a) SELECT ord, CAST(dense_rank() OVER (ORDER BY root) AS INTEGER) AS label, count(*) OVER (PARTITION BY root) AS size FROM m")
def g1_euclidean_clusters(spark, d):
    return G.cluster(M.cloud_emb(spark, d), 0.07).select("ord", "label", "size")


# Functions

LIN = "CASE WHEN {0} / 255.0 <= 0.04045 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END"


@query(f"SELECT CAST(v AS INTEGER) AS v, round(CAST({LIN.format('v')} AS DOUBLE), 9) AS linear, CAST(floor(({LIN.format('v')}) * 255 + 0.5) AS INTEGER) AS linear_byte, CAST(v AS INTEGER) AS back FROM range(256) t(v)")
def c1_srgb_bytes(spark, d):
    v = F.col("id").cast("int")
    linear = C.byte_to_linear(v)
    return spark.range(256).select(v.alias("v"), F.round(linear, 9).alias("linear"), C.byte_to_linear_byte(v).alias("linear_byte"), C.linear_to_byte(linear).alias("back"))


def _wheel_sql(hue: str, c: float, m: float) -> str:
    h = f"((({hue}) - 360 * floor(({hue}) / 360)) / 60)"
    x = f"({c!r} * (1 - abs({h} - 2 * floor({h} / 2) - 1)))"
    pick = lambda *p: f"CAST(floor((CASE CAST(floor({h}) AS INTEGER) " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(p)) + f" END + {m!r}) * 255 + 0.5) AS INTEGER)"
    return f"{pick(c, x, 0, 0, x, c)} AS r, {pick(x, c, c, x, 0, 0)} AS g, {pick(0, 0, x, c, c, x)} AS b"


@query(f"SELECT CAST(k AS INTEGER) AS label, {_wheel_sql('(k - 1) * CAST(137.508 AS DOUBLE)', (1 - abs(2 * 0.55 - 1)) * 0.75, 0.55 - (1 - abs(2 * 0.55 - 1)) * 0.75 / 2)} FROM range(1, 200) t(k)")
def c2_label_colours(spark, d):
    rgb = C.label_colour(F.col("id"))
    return spark.range(1, 200).select(F.col("id").cast("int").alias("label"), *spread(rgb, "r", "g", "b"))


@query(f"SELECT CAST(k AS INTEGER) AS value, {_wheel_sql('(k - 32) * CAST(137.50776405003785 AS DOUBLE)', 0.95 * 0.8, 0.95 - 0.95 * 0.8)} FROM range(22, 256) t(k)")
def c3_class_colours(spark, d):
    return spark.range(22, 256).select(F.col("id").cast("int").alias("value"), *spread(C.class_colour(F.col("id")), "r", "g", "b"))


@query("SELECT CAST(k AS INTEGER) AS k, CASE WHEN k < 64 THEN '保留 ' ELSE '自定义 ' END || k AS name FROM range(22, 256) t(k)")
def c4_class_names(spark, d):
    return spark.range(22, 256).select(F.col("id").cast("int").alias("k"), C.class_name(F.col("id")).alias("name"))


def _ramp_sql() -> str:
    a = [f"[{', '.join(str(v[c]) for v in C.ELEVATION_ANCHORS)}]" for c in range(3)]
    each = ", ".join(f"CAST(floor({v}[i + 1] + ({v}[i + 2] - {v}[i + 1]) * (t - i) + 0.5) AS INTEGER) AS {n}" for v, n in zip(a, "rgb", strict=True))
    return f"SELECT CAST(k AS INTEGER) AS bin, {each} FROM (SELECT k, t, CAST(least(floor(t), 7) AS INTEGER) AS i FROM (SELECT k, CAST(k AS DOUBLE) / 255 * 8 AS t FROM range(256) r(k)))"


@query(_ramp_sql())
def c5_elevation_ramp(spark, d):
    return spark.range(256).select(F.col("id").cast("int").alias("bin"), *spread(C.elevation_ramp(F.col("id")), "r", "g", "b"))


@query(f"WITH {EMB} SELECT ord, round(greatest(-0.2, least(x, y)), 6) AS low FROM cloud WHERE greatest(x, y) >= -0.2 AND least(x, y) <= 0.2 AND least(0.2, greatest(x, y)) - greatest(-0.2, least(x, y)) >= 0.4 / 256")
def c6_elevation_range(spark, d):
    cloud = M.cloud_emb(spark, d)
    found = C.normalize_range(F.lit(-0.2), F.lit(0.2), F.col("x"), F.col("y"))
    inside = (F.greatest("x", "y") >= -0.2) & (F.least("x", "y") <= 0.2) & (F.least(F.lit(0.2), F.greatest("x", "y")) - F.greatest(F.lit(-0.2), F.least("x", "y")) >= 0.4 / 256)
    return cloud.where(inside).select("ord", r6(found["min"]).alias("low"))


@query(f"WITH {EMB} SELECT a.ord, round(sqrt({D2}), 6) AS distance, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS dxy, round(b.z - a.z, 6) AS dz FROM cloud a JOIN cloud b ON b.ord = a.ord + 1")
def m1_distances(spark, d):
    cloud = M.cloud_emb(spark, d)
    pairs = cloud.select(F.struct("*").alias("a"), (F.col("ord") + 1).alias("k")).join(cloud.select(F.struct("*").alias("b"), F.col("ord").alias("k")), "k")
    found = pairs.select(F.col("a.ord").alias("ord"), S.distance("a", "b").alias("m"))
    return found.select("ord", *[r6(f"m.{c}").alias(c) for c in ("distance", "dxy", "dz")])


@query(f"WITH {EMB}, t AS (SELECT a.ord, sqrt({D2}) AS ab, sqrt((b.x - c.x) * (b.x - c.x) + (b.y - c.y) * (b.y - c.y) + (b.z - c.z) * (b.z - c.z)) AS bc, sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) + (a.z - c.z) * (a.z - c.z)) AS ca FROM cloud a JOIN cloud b ON b.ord = a.ord + 1 JOIN cloud c ON c.ord = a.ord + 2) SELECT ord, round(ab, 6) AS ab, round(bc, 6) AS bc, round(ca, 6) AS ca, round(degrees(acos((ab * ab + ca * ca - bc * bc) / (2 * ab * ca))), 4) AS angle_a FROM t")
def m2_triangles(spark, d):
    cloud = M.cloud_emb(spark, d)
    side = lambda n, k: cloud.select(F.struct("*").alias(n), (F.col("ord") - k).alias("k"))
    found = side("a", 0).join(side("b", 1), "k").join(side("c", 2), "k").select(F.col("a.ord").alias("ord"), S.triangle("a", "b", "c").alias("m"))
    return found.select("ord", *[r6(f"m.{c}").alias(c) for c in ("ab", "bc", "ca")], F.round("m.angle_a", 4).alias("angle_a"))


@query(f"WITH {EMB} SELECT ord, printf('X: %.4f  Y: %.4f  Z: %.4f', round(x, 3) + 0.0, round(y, 3) + 0.0, round(z, 3) + 0.0) AS line FROM cloud")
def m3_formats(spark, d):
    x, y, z = (F.round(n, 3) + 0.0 for n in "xyz")
    return M.cloud_emb(spark, d).select("ord", S.center_line(x, y, z).alias("line"))


@query("SELECT n_nationkey AS k, (CAST(n_regionkey AS BIGINT) << 24) | n_nationkey AS code, CAST(n_regionkey AS BIGINT) AS node, CAST(n_nationkey AS BIGINT) AS index, CASE WHEN (n_nationkey >> n_regionkey) & 1 = 0 THEN -1 ELSE CAST(bit_count(n_nationkey & ((1 << n_regionkey) - 1)) AS INTEGER) END AS child FROM nation")
def m4_packed_ids(spark, d):
    code = S.packed(F.col("n_regionkey"), F.col("n_nationkey"))
    return M.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), code.alias("code"), *spread(S.unpacked(code), "node", "index"), F.expr("case when shiftright(n_nationkey, n_regionkey) & 1 = 0 then -1 else bit_count(n_nationkey & (shiftleft(1, n_regionkey) - 1)) end").alias("child"))


@query(f"WITH {EMB} SELECT ord, round((1.5 * x / (2 - z) + 1) / 2 * 800, 4) AS px, round((1 - 1.5 * y / (2 - z)) / 2 * 600, 4) AS py FROM cloud")
def m5_screen_positions(spark, d):
    at = S.to_screen(EYE, 800, 600)
    return M.cloud_emb(spark, d).select("ord", F.round(at["px"], 4).alias("px"), F.round(at["py"], 4).alias("py"))


@query("SELECT CAST(i AS INTEGER) AS i, CASE WHEN m = 'label' AND i % 2 = 0 THEN CASE WHEN i % 3 = 0 THEN 'rgb' ELSE 'none' END WHEN m = 'rgb' THEN CASE WHEN i % 3 = 0 THEN 'rgb' ELSE 'none' END WHEN m = 'normal' AND i % 5 <> 0 THEN 'none' ELSE m END AS mode FROM (SELECT i, ['label', 'rgb', 'normal', 'elevation'][i % 4 + 1] AS m FROM range(60) t(i))")
def c7_colour_modes(spark, d):
    i = F.col("id").cast("int")
    mode = F.element_at(F.array(*[F.lit(x) for x in ("label", "rgb", "normal", "elevation")]), (i % 4 + 1).cast("int"))
    return spark.range(60).select(i.alias("i"), C.colour_mode(mode, i % 2 != 0, i % 3 == 0, i % 5 == 0).alias("mode"))


@query(f"WITH {EMB}, u AS (SELECT ord, (x / sqrt(x * x + y * y + z * z) + 1) / 2 AS r, (y / sqrt(x * x + y * y + z * z) + 1) / 2 AS g, (z / sqrt(x * x + y * y + z * z) + 1) / 2 AS b FROM cloud) SELECT ord, " + ", ".join(f"CAST(floor((CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END) * 255 + 0.5) AS INTEGER) AS {c}" for c in "rgb") + " FROM u")
def c8_normal_colours(spark, d):
    n = F.sqrt(F.expr("x * x + y * y + z * z"))
    return M.cloud_emb(spark, d).select("ord", *spread(C.normal_colour(F.col("x") / n, F.col("y") / n, F.col("z") / n), "r", "g", "b"))


@query()
def c9_derived_shades(spark, d):
    rows = spark.range(22).join(spark.range(3).withColumnRenamed("id", "k"), F.lit(True))
    c = C.class_colour(F.col("id"))
    return rows.select("id", "k", *spread(C.derived_shade(c["r"], c["g"], c["b"], F.col("k"), F.lit(3)), "r", "g", "b"))


@query("SELECT CAST(k AS INTEGER) AS k, CAST(CASE WHEN k % 2 = 0 THEN (k * 257) >> 8 ELSE k END AS INTEGER) AS v FROM range(256) t(k)")
def s5_las_colours(spark, d):
    k = F.col("id").cast("int")
    return spark.range(256).select(k.alias("k"), C.las_colour(F.when(k % 2 == 0, k * 257).otherwise(k), F.when(k % 2 == 0, 65535).otherwise(200)).cast("int").alias("v"))


@query(f"WITH {EMB}, b AS (SELECT (min(x) + max(x)) / 2 AS bx, (min(y) + max(y)) / 2 AS by_, (min(z) + max(z)) / 2 AS bz FROM cloud) SELECT ord, CAST(x - bx AS FLOAT) AS x, CAST(y - by_ AS FLOAT) AS y, CAST(z - bz AS FLOAT) AS z FROM cloud, b")
def s11_display_coordinates(spark, d):
    cloud = M.cloud_emb(spark, d)
    original = cloud.select("ord", *[F.col(n).alias(f"o{n}") for n in "xyz"])
    return M.display(original, M.base_point(A.bbox(cloud))).select("ord", "x", "y", "z")


@query("SELECT p_partkey AS k, floor(greatest(w / (pow(10, floor(log10(w))) / 2), 1)) * (pow(10, floor(log10(w))) / 2) AS bar, round(2 * 3.0 / (2.0 * w), 9) AS per_pixel FROM (SELECT p_partkey, p_retailprice / 7 AS w FROM part)")
def m6_scale_bars(spark, d):
    w = F.col("p_retailprice") / 7
    return M.table(spark, d, "part").select(F.col("p_partkey").alias("k"), S.scale_bar(w).alias("bar"), F.round(S.units_per_pixel(F.lit(3.0), F.lit(2.0), w), 9).alias("per_pixel"))


@query("SELECT CAST(i AS INTEGER) AS i, ['a.las', 'a_b_c.ply', 'cloud.las', 'x.las.bak.las', 'cloud.las', 'Tree 6 (3+5).las'][i + 1] AS name, ['0.05', '0.65', '5', '12', '150', '0.5'][i + 1] AS label FROM range(6) t(i)")
def k8_file_names(spark, d):
    rows = [(0, "a.LAS", "las", 0.05), (1, "a/b:c", "ply", 0.65), (2, "///", "las", 5.0), (3, "x.las.bak", "las", 12.0), (4, "", "las", 150.0), (5, "Tree 6 (3+5)", "las", 0.5)]
    df = spark.createDataFrame(rows, "i int, raw string, ext string, v double")
    return df.select("i", F.when(F.col("ext") == "las", S.file_name(F.col("raw"), "las")).otherwise(S.file_name(F.col("raw"), "ply")).alias("name"), S.scale_label(F.col("v")).alias("label"))


# Models, rasters and files: on a scene made here where the tables hold no geometry


def _scene(spark) -> DataFrame:
    """Soil with a slope, a wire along x, a block, a trunk: from spark.range, without random numbers."""
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_000)) / 10_000.0
    n = spark.range(3000)
    soil = n.select((h(1) * 60).alias("x"), (h(2) * 30).alias("y")).withColumn("z", 0.02 * F.col("x")).withColumn("part", F.lit(0))
    wire = spark.range(400).select((F.col("id") * 0.15).alias("x"), F.lit(15.0).alias("y"), (12 + F.pow(F.col("id") * 0.15 - 30, 2) / 300).alias("z"), F.lit(1).alias("part"))
    block = spark.range(400).select((20 + h(3) * 8).alias("x"), (4 + h(4) * 6).alias("y"), F.lit(5.0).alias("z"), F.lit(2).alias("part"))
    trunk = spark.range(1200).select((45 + 0.15 * F.cos(F.col("id") * 0.7)).alias("x"), (24 + 0.15 * F.sin(F.col("id") * 0.7)).alias("y"), (0.9 + F.col("id") * 0.005).alias("z"), F.lit(3).alias("part"))
    rows = soil.unionByName(wire).unionByName(block).unionByName(trunk)
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("part").orderBy("x", "y", "z"))
    return rows.withColumn("ord", (F.col("part") * 10_000 + order).cast("long")).withColumn("classification", F.element_at(F.array(*[F.lit(c) for c in (2, 15, 6, 4)]), F.col("part") + 1))


@query()
def f8_hag_gate(spark, d):
    from .operators.ground import with_ground

    scene = _scene(spark)
    return L.hag_gate(with_ground(scene, scene.where("classification = 2"), 2.0), 4.0).select("ord", r6("ground").alias("ground"))


@query()
def f9_line_candidates(spark, d):
    from .operators.ground import line_candidates

    scene = _scene(spark)
    return line_candidates(scene, scene.where("classification = 2"), 4.0, 1.0).select("ord", "n", r6("linearity").alias("linearity"))


@query()
def f10_refined_lines(spark, d):
    from .operators.normals import features

    return L.refine_lines(L.loose_line_gate(features(M.cloud_emb(spark, d), 0.1))).select("ord", "n")


@query(f"WITH {EMB}, p AS (SELECT ord, greatest(0.0, least(4.0, (x + 0.3) / 0.15)) AS u, greatest(0.0, least(3.0, (y + 0.3) / 0.15)) AS v FROM cloud), c AS (SELECT *, floor(u) AS a, floor(v) AS b, least(floor(u) + 1, 4) AS a1, least(floor(v) + 1, 3) AS b1 FROM p) SELECT ord, round((2 * a + b * b) + ((2 * a1 + b * b) - (2 * a + b * b)) * (u - a) + (((2 * a + b1 * b1) + ((2 * a1 + b1 * b1) - (2 * a + b1 * b1)) * (u - a)) - ((2 * a + b * b) + ((2 * a1 + b * b) - (2 * a + b * b)) * (u - a))) * (v - b), 6) AS ground FROM c")
def j6_raster_lookup(spark, d):
    raster = spark.range(20).select((F.col("id") % 5).alias("col"), F.floor(F.col("id") / 5).alias("row")).withColumn("z", (2 * F.col("col") + F.col("row") * F.col("row")).cast("double"))
    return J.raster_lookup(M.cloud_emb(spark, d), raster, 5, 4, 0.15, (-0.3, -0.3)).select("ord", r6("ground").alias("ground"))


#: Line ends: ord, line, place, outward direction.
ENDS = "(1, 1, 0.0, 0.0, 9.0, -1.0, 0.0, 0.0), (2, 1, 50.0, 0.0, 9.0, 1.0, 0.0, 0.0), (3, 2, 56.0, 0.2, 9.0, -1.0, 0.0, 0.0), (4, 2, 90.0, 0.2, 9.0, 1.0, 0.0, 0.0), (5, 3, 55.0, 4.0, 9.0, -1.0, 0.0, 0.0)"


@query(f"WITH e AS (SELECT * FROM (VALUES {ENDS}) t(ord, line, x, y, z, dx, dy, dz)), p AS (SELECT a.ord AS a, b.ord AS b, CAST(sqrt({D2}) AS DOUBLE) AS d, a.dx * (b.x - a.x) + a.dy * (b.y - a.y) + a.dz * (b.z - a.z) AS along_a, b.dx * (a.x - b.x) + b.dy * (a.y - b.y) + b.dz * (a.z - b.z) AS along_b FROM e a JOIN e b ON a.ord < b.ord AND a.line <> b.line AND {D2} <= 100 AND {D2} > 0), c AS (SELECT a, b, d, least(1.0, along_a / d) AS ca, least(1.0, along_b / d) AS cb FROM p) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(d * sqrt(1 - ca * ca) + d * (acos(ca) + acos(cb)) / 2, 6) AS score FROM c WHERE ca >= cos(radians(12)) AND cb >= cos(radians(12)) AND d * sqrt(1 - ca * ca) <= 0.5")
def j8_endpoint_join(spark, d):
    ends = spark.createDataFrame([(1, 1, 0.0, 0.0, 9.0, -1.0, 0.0, 0.0), (2, 1, 50.0, 0.0, 9.0, 1.0, 0.0, 0.0), (3, 2, 56.0, 0.2, 9.0, -1.0, 0.0, 0.0), (4, 2, 90.0, 0.2, 9.0, 1.0, 0.0, 0.0), (5, 3, 55.0, 4.0, 9.0, -1.0, 0.0, 0.0)], "ord long, line long, x double, y double, z double, dx double, dy double, dz double")
    return J.endpoint_join(ends, 10.0, 12.0, 0.5).select(F.col("a.ord").alias("a"), F.col("b.ord").alias("b"), r6("score").alias("score"))


@query()
def a13_tree_diameters(spark, d):
    from .operators.trees import diameters

    return diameters(_scene(spark).where("part = 3").withColumn("entity_id", F.lit(7))).select("entity_id", r6("height").alias("height"), F.round("dbh", 3).alias("dbh"), "dbh_method")


@query()
def a17_filled_raster(spark, d):
    from .operators.ground import filled_raster

    return filled_raster(M.cloud_emb(spark, d), 0.05)[0].select("col", "row", r6("z").alias("z"))


@query("SELECT vec_id AS ord, CAST(k AS INTEGER) AS k, round(CAST(embedding[1] AS DOUBLE) + 0.5 * cos(k * 2 * pi() / 8), 6) AS px, round(CAST(embedding[2] AS DOUBLE) + 0.5 * sin(k * 2 * pi() / 8), 6) AS py FROM embeddings, range(8) r(k)")
def t1_marker_rings(spark, d):
    from .operators.trees import ring

    return ring(M.cloud_emb(spark, d).withColumn("r", F.lit(0.5)), "r", 8).select("ord", "k", r6("px").alias("px"), r6("py").alias("py"))


@query()
def g2_elastic_ground(spark, d):
    from .operators.ground import classify_ground_elastic

    return classify_ground_elastic(_scene(spark), 1.5, 0.5).groupBy("part", "ground").agg(F.count("*").alias("n"))


@query()
def g3_liquid_ground(spark, d):
    from .operators.ground import classify_ground

    return classify_ground(_scene(spark), 1.0, 0.4).groupBy("part", "ground").agg(F.count("*").alias("n"))


@query()
def g7_power_lines(spark, d):
    from .operators.ground import line_candidates
    from .operators.powerline import trace

    scene = _scene(spark)
    return trace(line_candidates(scene, scene.where("classification = 2"), 4.0, 1.0))[1].select("line", "points", r6("length").alias("length"), r6("sag").alias("sag"))


@query()
def g8_fit_plane(spark, d):
    from .operators.fitting import fit_plane

    p = fit_plane(_scene(spark), 0.05)
    return spark.createDataFrame([(*p.normal, p.d, p.inliers)], "nx double, ny double, nz double, d double, inliers long")


@query()
def g9_fit_cylinder(spark, d):
    from .operators.fitting import fit_cylinder

    c = fit_cylinder(_scene(spark).where("part = 3 or part = 2"), 0.02, axis=(0.0, 0.0, 1.0), high=1.0)
    return spark.createDataFrame([(*c.center, c.radius, c.half_height, c.inliers)], "x double, y double, z double, radius double, half_height double, inliers long")


@query()
def g10_normals(spark, d):
    from .operators.normals import estimate

    return estimate(M.cloud_emb(spark, d), 0.1, "+z").select("ord", "code")


@query()
def g10_normals_quadric(spark, d):
    from .operators.normals import estimate

    return estimate(M.cloud_emb(spark, d), 0.12, "+z", "quadric").select("ord", "code")


@query()
def g11_auto_radius(spark, d):
    from .operators.normals import auto_radius

    return spark.createDataFrame([(float(auto_radius(M.cloud_emb(spark, d), 0.05)),)], "radius double")


@query("SELECT 1.0 AS x, 0.0 AS y, -2.0 AS z, 0.0 AS xx, -1.0 AS xy FROM (SELECT count(*) AS n FROM embeddings) WHERE n >= 3")
def g13_align_pairs(spark, d):
    from .operators.registration import align_pairs

    left = M.cloud_emb(spark, d).withColumnRenamed("ord", "index")
    right = left.select("index", (-F.col("y") + 1).alias("x"), F.col("x").alias("y"), (F.col("z") - 2).alias("z"))
    found = align_pairs(left, right)
    return spark.createDataFrame([tuple(round(v, 6) + 0.0 for v in (*found["translation"], *found["rotation"][0][:2]))], "x double, y double, z double, xx double, xy double")


@query()
def g14_icp(spark, d):
    from .operators.registration import icp

    cloud = M.cloud_emb(spark, d)
    got = icp(cloud, cloud.select("ord", (F.col("x") + 0.01).alias("x"), (F.col("y") - 0.01).alias("y"), "z"))
    return spark.createDataFrame([(round(got["translation"][0], 4), round(got["translation"][1], 4), len(got["rms"]))], "x double, y double, rounds int")


@query()
def g15_gicp(spark, d):
    from .operators.registration import gicp

    cloud = M.cloud_emb(spark, d)
    got = gicp(cloud, cloud.select("ord", (F.col("x") + 0.01).alias("x"), (F.col("y") - 0.01).alias("y"), "z"))
    return spark.createDataFrame([(round(got["translation"][0], 3), round(got["translation"][1], 3))], "x double, y double")


def _octree_sql(cell: int, depth: int) -> str:
    top = (1 << depth) - 1
    step = ", ".join(f"CAST(least(floor(({n} - m{n}) / size * {1 << depth}), {top}) AS BIGINT) AS i{n}" for n in "xyz")
    code = "1"
    for k in range(depth - 1, -1, -1):
        code = f"({code}) * 8 + ((ix >> {k}) & 1) * 4 + ((iy >> {k}) & 1) * 2 + ((iz >> {k}) & 1)"
    counts = ", ".join(f"count(*) OVER (PARTITION BY path >> {3 * (depth - k)}) AS n{k}" for k in range(depth))
    level = "CASE " + " ".join(f"WHEN n{k} <= {cell} THEN {k}" for k in range(depth)) + f" ELSE {depth} END"
    return f"WITH {EMB}, b AS (SELECT min(x) AS mx, min(y) AS my, min(z) AS mz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS size FROM cloud), i AS (SELECT ord, {step} FROM cloud, b), p AS (SELECT ord, CAST({code} AS BIGINT) AS path FROM i), c AS (SELECT *, {counts} FROM p), l AS (SELECT ord, path, {level} AS depth FROM c) SELECT ord, CAST(depth AS INTEGER) AS depth, path >> (3 * ({depth} - depth)) AS leaf FROM l"


@query(_octree_sql(32, 4))
def g16_octree(spark, d):
    from .operators.octree import assign

    return assign(M.cloud_emb(spark, d), 32, 4).select("ord", "depth", "leaf")


@query()
def g17_budgeted_sample(spark, d):
    from .operators.octree import assign, budget

    return budget(assign(M.cloud_emb(spark, d), 32, 4), 120).select("ord")


#: A view's planes: normal inwards, constant.
PLANES = [(1.0, 0.0, 0.0, 0.1), (-0.6, 0.8, 0.0, 0.12), (0.0, 0.0, 1.0, 0.15)]


def _flags_sql() -> str:
    spot = ", ".join("m{0} + size * ({1} + 0.5) / (1 << k) AS c{0}".format(n, " + ".join(f"CASE WHEN {b} < k THEN ((c >> {3 * b + 2 - j}) & 1) << {b} ELSE 0 END" for b in range(4))) for j, n in enumerate("xyz"))
    far = [f"cx * {p[0]} + cy * {p[1]} + cz * {p[2]} + {p[3]}" for p in PLANES]
    state = "CASE WHEN " + " OR ".join(f"{f} < -r" for f in far) + " THEN 0 WHEN " + " OR ".join(f"{f} < r" for f in far) + " THEN 1 ELSE 2 END"
    return f"""o AS ({_octree_sql(32, 4)}), {EMB}, b AS (SELECT min(x) AS mx, min(y) AS my, min(z) AS mz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS size FROM cloud),
l AS (SELECT leaf, depth, count(*) AS n FROM o GROUP BY leaf, depth), c AS (SELECT l.*, k, leaf >> CAST(3 * (depth - k) AS INTEGER) AS c FROM l, (SELECT CAST(range AS INTEGER) AS k FROM range(5)) WHERE k <= depth),
m AS (SELECT leaf, depth, n, k, size / (1 << k) * sqrt(3) / 2 AS r, {spot} FROM c, b), s AS (SELECT leaf, depth, n, k, {state} AS state FROM m),
f AS (SELECT leaf, depth, n, CAST(coalesce(arg_min(state, k) FILTER (WHERE state <> 1), 1) AS INTEGER) AS state FROM s GROUP BY leaf, depth, n)"""


@query(f"WITH {_flags_sql()} SELECT leaf, depth, n, state FROM f")
def g17_frustum_flags(spark, d):
    from .operators.octree import assign, flagged

    return flagged(assign(M.cloud_emb(spark, d), 32, 4), PLANES)


@query(f"WITH {_flags_sql()}, k AS (SELECT leaf, n, least(n, CAST(ceil(n * 120.0 / sum(n) OVER ()) AS BIGINT)) AS k FROM f WHERE state <> 0), w AS (SELECT ord, n, k, row_number() OVER (PARTITION BY leaf ORDER BY ord) - 1 AS r FROM o JOIN k USING (leaf)) SELECT ord FROM w WHERE list_contains(list_transform(range(k), lambda j: (j * n) // k), r)")
def g17_gathered_points(spark, d):
    from .operators.octree import assign, flagged, gathered

    placed = assign(M.cloud_emb(spark, d), 32, 4)
    return gathered(placed, flagged(placed, PLANES), 120).select("ord")


@query()
def g17_quotas(spark, d):
    from .operators.octree import quotas

    seen = M.cloud_evt(spark, d).groupBy("entity_id").agg(F.sum((F.col("z") > 50).cast("long")).alias("visible"), F.count("*").alias("capacity"))
    return quotas(seen, 500).select("entity_id", "visible", "quota")


@query(f"WITH {EMB} SELECT ord, floor(round(x, 3) * 1000 + 0.5) AS x, CAST(abs(classification) AS SMALLINT) AS classification FROM cloud")
def k4_las_round_trip(spark, d):
    from .plans.lineage import folder
    from .sources.las import read_las, write_las

    points = M.cloud_emb(spark, d).select("ord", *[F.round(n, 3).alias(f"o{n}") for n in "xyz"], F.col("classification").cast("smallint").alias("classification"), F.lit(0).alias("treeid"))
    # A box whose centre lies on the grid of 0.001, so that all coordinates do.
    corners = spark.createDataFrame([(1_000_000, -1.0, -1.0, -1.0, 0, 0), (1_000_001, 1.0, 1.0, 1.0, 0, 0)], "ord long, ox double, oy double, oz double, classification smallint, treeid int")
    path = folder(spark) + ".las"
    kept = G.numbered(points, "ord", "place").withColumn("place", F.col("place") - 1)
    write_las(points.unionByName(corners.withColumn("classification", F.col("classification").cast("smallint"))), path)
    back = read_las(spark, path).join(kept.select("ord", "place").withColumnRenamed("ord", "own"), F.col("ord") == F.col("place"))
    return back.select(F.col("own").alias("ord"), F.floor(F.col("ox") * 1000 + 0.5).cast("double").alias("x"), "classification")


@query(f"WITH {EMB} SELECT count(*) AS n, round(min(x), 9) AS min_x, round(max(z), 9) AS max_z FROM cloud")
def k1_ply_round_trip(spark, d):
    from .plans.lineage import folder
    from .sources.ply import read_ply, write_ply

    points = M.cloud_emb(spark, d).select("ord", *[F.col(n).alias(f"o{n}") for n in "xyz"], F.col("classification").cast("smallint").alias("classification"), F.lit(0).alias("treeid"))
    path = folder(spark) + ".ply"
    write_ply(points, path)
    return read_ply(spark, path).agg(F.count("*").alias("n"), F.round(F.min("ox"), 9).alias("min_x"), F.round(F.max("oz"), 9).alias("max_z"))


@query()
def g4_isolated_trees(spark, d):
    from .operators.trees import isolate_trees

    h = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_000)) / 10_000.0
    n = spark.range(1200).withColumn("k", F.col("id") % 2)
    trunk = F.col("id") % 3 == 0
    x = F.col("k") * 8 + F.when(trunk, 0.15 * F.cos(F.col("id"))).otherwise(h(1) * 2 - 1)
    y = F.when(trunk, 0.15 * F.sin(F.col("id"))).otherwise(h(2) * 2 - 1)
    z = F.when(trunk, h(3) * 5).otherwise(5 + h(4) * 2)
    stand = n.select(F.lit(1).alias("entity_id"), F.col("id").alias("ord"), x.alias("x"), y.alias("y"), z.alias("z"), "k")
    return isolate_trees(stand, cell1=0.2, cell2=0.3).groupBy("k", "tree").agg(F.count("*").alias("n"))


@query(f"WITH {EMB} SELECT round(min(x), 9) AS min_x, round(max(x), 9) AS max_x, round(min(y), 9) AS min_y, round(max(y), 9) AS max_y, round(min(z), 9) AS min_z, round(max(z), 9) AS max_z FROM cloud")
def s8_ply_box(spark, d):
    from .plans.lineage import folder
    from .sources.ply import read_cloud, scan_box, write_ply

    points = M.cloud_emb(spark, d).select("ord", *[F.col(n).alias(f"o{n}") for n in "xyz"], F.col("classification").cast("smallint").alias("classification"), F.lit(0).alias("treeid"))
    path = folder(spark) + ".ply"
    write_ply(points, path)
    box = scan_box(read_cloud(spark, path))
    return box.select(*[F.round(n, 9).alias(n) for n in box.columns])


@query(f"WITH {EMB}, h AS (SELECT ord, z, round(z * 10 - 3, 6) AS ground FROM cloud) SELECT ord FROM h WHERE z - ground >= 1.5")
def f8_hag_gate_of_table(spark, d):
    points = M.cloud_emb(spark, d).withColumn("ground", F.round(F.col("z") * 10 - 3, 6))
    return L.hag_gate(points, 1.5).select("ord")


@query(f"WITH {EMB}, n AS (SELECT a.ord, count(*) AS n FROM cloud a JOIN cloud b ON {D2} <= 0.1 * 0.1 GROUP BY a.ord), f AS (SELECT c.ord, n, (x + 1) / 2 AS linearity, y AS verticality FROM cloud c JOIN n USING (ord)) SELECT ord, n FROM f WHERE linearity >= 0.55 AND abs(verticality) <= sin(radians(25)) AND n >= 3")
def f10_line_gates_of_table(spark, d):
    cloud = M.cloud_emb(spark, d)
    n = J.range_join(cloud.select("ord", "x", "y", "z"), cloud.select("ord", "x", "y", "z"), 0.1).groupBy(F.col("a.ord").alias("ord")).agg(F.count("*").alias("n"))
    features = cloud.join(n, "ord").select("ord", "n", ((F.col("x") + 1) / 2).alias("linearity"), F.col("y").alias("verticality"))
    return L.refine_lines(L.loose_line_gate(features), 0.55).select("ord", "n")
