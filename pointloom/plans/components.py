"""Connected components as a fixpoint of DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import written

#: A vertex is a hub if it has more rows than this, and more than one in HUBS of all rows:
#: so there are fewer hubs than HUBS, and their table may be broadcast.
HUB_ROWS, HUBS = 1000, 20_000
#: Shares that a hub's rows are dealt out to.
SALTS = 32
#: So many edges (16 MB) are joined in one task, without rounds.
ALONE = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star around the least vertex of each component of the given edges."""
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(names))
    while True:
        # Each edge hands the lesser root to the greater one; then all look up their root's root.
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(names)))
    return names[own], names[root[own]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v = forest(batch.column("u").to_numpy(), batch.column("v").to_numpy())
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of all batches: ALONE edges at most."""
    held = list(batches)
    if held:
        table = pa.Table.from_batches(held)
        u, v = forest(table["u"].to_numpy(), table["v"].to_numpy())
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _with_least(edges: DataFrame, total: int, least: DataFrame) -> DataFrame:
    """Edges (u, v) with m of their u; the rows of hubs are dealt out by v. total: no fewer than there are edges."""
    if total <= HUB_ROWS:  # so there is no hub
        return edges.join(least, "u")
    hubs = F.broadcast(edges.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > max(HUB_ROWS, -(-total // HUBS))).select("u", F.lit(True).alias("hub")))
    dealt = edges.join(hubs, "u", "left").withColumn("salt", F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))).drop("hub")
    every = F.explode(F.when(F.col("hub"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    return dealt.join(least.join(hubs, "u", "left").withColumn("salt", every).drop("hub"), ["u", "salt"]).drop("salt")


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) of all vertices of edges that are not the least of their component.

    The edges of each batch become stars first. Then large-star and small-star steps
    alternate: each vertex hands its neighbours the least vertex it knows of, so that a
    component ends as a star around its least vertex, in a number of rounds that grows with
    the logarithm of the size. Minima are aggregated before they are joined, and a hub's rows
    are dealt out over SALTS shares, so that a hub is no group of rows in one task. Each round
    is written, which ends its lineage. As soon as there are no more than ALONE edges, one task
    joins them: rounds over few rows cost stages, files and executors' memory, not work. Null
    ends and loops are ignored.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(f"{a} is not null and {b} is not null and u <> v")
    e, before = written(e.mapInArrow(_forests, "u long, v long").distinct()), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now != before and 0 < now[0] <= ALONE:
            e, before = written(e.coalesce(1).mapInArrow(_forest, "u long, v long")), now
        if now == before or not now[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = _with_least(both, 2 * now[0], least).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _least(large)
        small = _with_least(large, now[0], least).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = written(small.where("u <> v").distinct())
