"""Level-of-detail octree, and samples drawn by it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import written
from .entities import guard
from .joins import AXES

CELL, DEPTH, DEEPEST = 256, 12, 20
OUTSIDE, CROSSING, INSIDE = 0, 1, 2
#: Fixed value: the share of a frame's points that is dealt out evenly among the entities in sight.
BALANCE = 0.25
#: Entities that a frame shows at most.
SHOWN = 10_000


def assign(points: DataFrame, cell: int = CELL, depth: int = DEPTH) -> DataFrame:
    """points with depth and leaf: the first cell on the way down that holds no more than ``cell`` points.

    leaf is the path of octants, three bits a level behind a leading 1. Cells that still
    hold more at the last level are leaves there. Counts run level by level over the points
    that are not placed yet; only counts by cell are shuffled before they are joined.
    """
    if not 0 <= depth <= DEEPEST:
        raise ValueError(f"the depth is 0 to {DEEPEST}: a path is one 64-bit number")
    box = points.agg(*[f(n).alias(f"{f.__name__}_{n}") for n in AXES for f in (F.min, F.max)]).first()
    if box["min_x"] is None:
        return points.withColumns({"depth": F.lit(0), "leaf": F.lit(1).cast("long")})
    size = max(box[f"max_{n}"] - box[f"min_{n}"] for n in AXES) or 1.0
    steps = {n: F.least(F.floor((F.col(n) - box[f"min_{n}"]) / size * (1 << depth)), F.lit((1 << depth) - 1)).cast("long") for n in AXES}
    code = F.lit(1).cast("long")
    own = points.select("ord", *[c.alias(f"i{n}") for n, c in steps.items()])
    for k in range(depth - 1, -1, -1):
        octant = sum((F.shiftright(f"i{n}", k).bitwiseAND(F.lit(1)) * (4 >> j) for j, n in enumerate(AXES)), F.lit(0))
        code = code * 8 + octant
    left, out = own.select("ord", code.alias("path")), None
    for level in range(depth + 1):
        at = left.withColumn("leaf", F.shiftright("path", 3 * (depth - level)))
        counts = at.groupBy("leaf").agg(F.count("*").alias("n"))
        full = counts.where(F.col("n") > cell) if level < depth else counts.limit(0)
        placed = written(at.join(full.select("leaf", F.lit(True).alias("full")), "leaf", "left"))
        done = placed.where("full is null").select("ord", F.lit(level).alias("depth"), "leaf")
        out = done if out is None else out.unionByName(done)
        left = placed.where("full").select("ord", "path")
        if left.isEmpty():
            break
    return points.join(out, "ord")


def nodes(assigned: DataFrame) -> DataFrame:
    """(leaf, depth, n) of all nodes, leaves and their ancestors."""
    leaves = assigned.groupBy("leaf", "depth").agg(F.count("*").alias("n"))
    each = leaves.withColumn("up", F.explode(F.sequence(F.lit(0), F.col("depth"))))
    return each.groupBy(F.expr("shiftright(leaf, 3 * up)").alias("leaf"), (F.col("depth") - F.col("up")).alias("depth")).agg(F.sum("n").alias("n"))


def budget(assigned: DataFrame, points: int) -> DataFrame:
    """About so many points, of each leaf its share by equal strides (at least one)."""
    total = assigned.agg(F.count("*").alias("__t"))
    w = Window.partitionBy("leaf")
    own = assigned.crossJoin(F.broadcast(total)).withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy("ord")) - 1)  # one row
    stride = F.greatest(F.lit(1.0), F.least(F.col("__t") / points, F.col("__n").cast("double")))
    return own.where(F.floor(F.col("__r") / stride) != F.floor((F.col("__r") - 1) / stride)).drop("__t", "__n", "__r")


def flagged(assigned: DataFrame, planes: list[tuple[float, float, float, float]]) -> DataFrame:
    """(leaf, depth, n, state) of each leaf, as the planes (normal inwards, constant) see the sphere around its cell.

    OUTSIDE: wholly behind a plane, INSIDE: wholly before all of them, CROSSING: neither. The
    first cell on the way down that does not cross decides for all below it. The cells of a
    leaf's path follow from the path, so nothing is joined. Without planes all is INSIDE.
    """
    box = assigned.agg(*[f(n).alias(f"{f.__name__}_{n}") for n in AXES for f in (F.min, F.max)]).first()
    leaves = assigned.groupBy("leaf", "depth").agg(F.count("*").alias("n"))
    if box["min_x"] is None:
        return leaves.withColumn("state", F.lit(OUTSIDE))
    half = (max(box[f"max_{n}"] - box[f"min_{n}"] for n in AXES) or 1.0) / 2

    def seen(centre: list[Column], radius: Column) -> Column:
        far = [sum((c * v for c, v in zip(centre, p, strict=False)), F.lit(0.0)) + p[3] for p in planes]
        behind = [F.when(d < -radius, OUTSIDE).when(d < radius, CROSSING).otherwise(INSIDE) for d in far]
        return F.least(F.lit(INSIDE), *behind) if behind else F.lit(INSIDE)

    def cell(centre: list[Column], size: Column, state: Column) -> Column:
        return F.struct(*[c.alias(n) for c, n in zip(centre, AXES, strict=True)], size.alias("half"), state.alias("state"))

    def step(at: Column, level: Column) -> Column:
        octant = F.call_function("shiftright", F.col("leaf"), 3 * (F.col("depth") - level)).bitwiseAND(F.lit(7))
        size = at["half"] / 2
        centre = [at[n] + F.when(octant.cast("int").bitwiseAND(F.lit(4 >> j)) > 0, size).otherwise(-size) for j, n in enumerate(AXES)]
        return cell(centre, size, F.when(at["state"] != CROSSING, at["state"]).otherwise(seen(centre, size * math.sqrt(3))))

    middle = [F.lit(box[f"min_{n}"] + half) for n in AXES]
    root = cell(middle, F.lit(half), seen(middle, F.lit(half * math.sqrt(3))))
    way = F.when(F.col("depth") > 0, F.sequence(F.lit(1), F.col("depth"))).otherwise(F.array().cast("array<int>"))
    return leaves.withColumn("state", F.aggregate(way, root, step)["state"])


def quotas(entities: DataFrame, points: int) -> DataFrame:
    """entities (entity_id, visible, capacity) with quota: a frame's points among those in sight.

    First each gets an even part of BALANCE of them. Then, in order of entity_id, each gets of
    what is left its part of all that is lacking, and the last one in sight may take the rest.
    None gets more than it shows or can hold, nor all more than there are. Each step needs
    what the one before it left, so no more than SHOWN entities are dealt out on the driver.
    """
    rows = guard(entities.select("entity_id", "visible", "capacity"), SHOWN, "entities").orderBy("entity_id").collect()
    most = {r["entity_id"]: min(r["visible"], r["capacity"]) for r in rows if (r["visible"] or 0) > 0}
    got = {k: min(v, math.ceil(points * BALANCE / len(most))) if points > 0 else 0 for k, v in most.items()}
    left, lack = max(points, 0) - sum(got.values()), sum(most.values()) - sum(got.values())
    last = next(reversed(got), None)
    for k in got if left > 0 and lack > 0 else ():
        need = most[k] - got[k]
        part = left if k == last else math.ceil(need / lack * left)
        more = min(need, part, left)
        got[k], left = got[k] + more, left - more
    dealt = entities.sparkSession.createDataFrame([(int(k), int(v)) for k, v in got.items()], "entity_id long, quota long")
    return entities.join(dealt, "entity_id", "left").select(*entities.columns, F.coalesce("quota", F.lit(0).cast("long")).alias("quota"))


def gathered(assigned: DataFrame, leaves: DataFrame, points: int) -> DataFrame:
    """The points that a frame of so many shows: of each leaf in sight its share, at equal strides.

    leaves: see ``flagged``. Shares are rounded up leaf by leaf, in proportion to the leaves'
    points, so all leaves in sight show some and there may be one too many for each of them.
    A leaf's points at half the stride hold those at the whole one.
    """
    live = leaves.where(F.col("state") != OUTSIDE)
    total = live.agg(F.sum("n").alias("__t"))
    taken = F.least(F.col("n"), F.ceil(F.col("n") * F.lit(float(max(points, 0))) / F.col("__t")))
    shares = live.crossJoin(F.broadcast(total)).select("leaf", F.col("n").alias("__n"), taken.alias("__k"))  # one row
    row = F.row_number().over(Window.partitionBy("leaf").orderBy("ord")) - 1
    own = assigned.join(shares.where("__k > 0"), "leaf").withColumn("__r", row)
    # Row r is floor(j n / k) for some j where j = ceil(r k / n) gives it back.
    j = F.floor((F.col("__r") * F.col("__k") + F.col("__n") - 1) / F.col("__n"))
    return own.where((j < F.col("__k")) & (F.floor(j * F.col("__n") / F.col("__k")) == F.col("__r"))).drop("__n", "__k", "__r")
