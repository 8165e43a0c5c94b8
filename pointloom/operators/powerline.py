"""Power lines: components of candidates, wires of each component, wires joined over gaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.lines import strip
from ..plans.components import connected_components
from ..plans.lineage import written
from .aggregates import line_stats
from .clustering import numbered
from .entities import guard
from .joins import angle_gated_pairs, endpoint_join
from .normals import features

CONNECT_ANGLE, LATERAL, MOST_LINES = 15.0, 0.5, 500


def trace(candidates: DataFrame, connect: float = 3.0, tolerance: float = 0.35, least_points: int = 20, least_length: float = 20.0, gap: float = 10.0, gap_angle: float = 12.0, direction_radius: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(points with line, lines with their figures) of candidates (ord, x, y, z).

    Points within ``connect`` of each other whose directions agree are connected; a
    component is one task, as it is one piece of wire or tower; wires are found in it, then
    joined end to end. Lengths and sizes are asked for after that. Lines are numbered by
    their first point; a point of no line has no row.
    """
    base = candidates.select("ord", "x", "y", "z")
    way = features(base, direction_radius).where("n >= 3").select("ord", "dx", "dy", "dz", "linearity")
    points = written(base.join(way, "ord", "left"))
    edges = angle_gated_pairs(points, connect, CONNECT_ANGLE).select(F.col("a.ord").alias("a"), F.col("b.ord").alias("b"))
    rooted = points.join(connected_components(edges).withColumnRenamed("id", "ord"), "ord", "left").withColumn("root", F.coalesce("root", "ord"))

    def wires(table: pa.Table) -> pa.Table:
        t = table.sort_by("ord")
        col = lambda n: t[n].to_numpy().astype(float)
        found = strip(np.stack([col(n) for n in "xyz"], axis=1), np.stack([col(f"d{n}") for n in "xyz"], axis=1), np.nan_to_num(col("linearity")), tolerance, least_points)
        ords = t["ord"].to_numpy()
        line = [np.full(len(k), ords[k].min()) for k, _ in found]
        both = (np.concatenate([ords[k] for k, _ in found]), np.concatenate(line)) if found else (ords[:0], ords[:0])
        return pa.table({"ord": pa.array(both[0], pa.int64()), "line": pa.array(both[1], pa.int64())})

    drafts = written(rooted.groupBy("root").applyInArrow(wires, "ord long, line long").join(base, "ord"))
    joined = _join(drafts, gap, gap_angle)
    merged = drafts.join(joined, "line").withColumn("line", F.col("into")).drop("into")
    long = line_stats(merged).where((F.col("points") >= least_points) & (F.col("length") >= least_length))
    long = long.join(joined.groupBy(F.col("into").alias("line")).agg((F.count("*") - 1).alias("gaps")), "line")
    number = numbered(guard(written(long), MOST_LINES, "lines"), "line", "number")
    return merged.join(number, "line").drop("line").withColumnRenamed("number", "line"), long.join(number, "line").drop("line").withColumnRenamed("number", "line")


def _join(drafts: DataFrame, gap: float, angle: float) -> DataFrame:
    """(line, into): wires that continue each other, best fit first, each end used once.

    Wires that candidate joins connect are one group of rows, one a pair of ends; what is
    joined in a group does not depend on others, so the best first within each is the best
    first of all.
    """
    s = drafts.groupBy("line").agg((F.max("x") - F.min("x") >= F.max("y") - F.min("y")).alias("by_x"))
    each = drafts.join(s, "line").withColumn("t", F.when(F.col("by_x"), F.col("x")).otherwise(F.col("y")))
    ends = each.groupBy("line").agg(*[f(F.struct("x", "y", "z"), F.struct("t", "ord")).alias(n) for f, n in ((F.min_by, "p"), (F.max_by, "q"))])
    size = F.sqrt(sum(((F.col(f"q.{n}") - F.col(f"p.{n}")) * (F.col(f"q.{n}") - F.col(f"p.{n}")) for n in ("x", "y")), F.lit(0.0)))
    ends = ends.withColumn("size", size).where("size > 0")
    # The chord's level direction; wires sag, so their ends are not level.
    row = lambda e, sign: ends.select((F.col("line") * 2 + (1 if e == "q" else 0)).alias("ord"), "line", *[F.col(f"{e}.{n}").alias(n) for n in "xyz"], *[(sign * (F.col(f"q.{n}") - F.col(f"p.{n}")) / F.col("size")).alias(f"d{n}") for n in "xy"], F.lit(0.0).alias("dz"))
    found = endpoint_join(row("p", -1).unionByName(row("q", 1)), gap, angle, LATERAL)
    pairs = written(found.select(F.col("a.line").alias("a"), F.col("b.line").alias("b"), F.col("a.ord").alias("i"), F.col("b.ord").alias("j"), "score"))
    roots = connected_components(pairs)
    grouped = pairs.join(roots.withColumnRenamed("id", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    into = grouped.groupBy("root").applyInArrow(_best_first, "line long, into long")
    return drafts.select("line").distinct().join(into, "line", "left").select("line", F.coalesce("into", "line").alias("into"))


def _best_first(table: pa.Table) -> pa.Table:
    """(line, into) of a group's wires: pairs by score, each end once, no wire closed to a ring; into is the least of those joined."""
    t = table.sort_by([("score", "ascending"), ("i", "ascending"), ("j", "ascending")])
    a, b, i, j = (t[n].to_pylist() for n in "abij")
    root = {k: k for k in (*a, *b)}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    used = set()
    for x, y, p, q in zip(a, b, i, j, strict=True):
        x, y = find(x), find(y)
        if x != y and not {p, q} & used:
            used |= {p, q}
            root[max(x, y)] = min(x, y)
    return pa.table({"line": pa.array(list(root), pa.int64()), "into": pa.array([find(k) for k in root], pa.int64())})
