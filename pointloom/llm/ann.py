"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates unit vectors by three rounds of random signs and a fast Hadamard transform
and files each under the signed axis nearest to it. A query looks under several axes of
each table, the nearest first. What is filed and asked are one-byte codes of the vectors with
a bound of their error, so that a vector is not sent whole once for each table. A bucket is
cut into pieces of bounded size, so that one with a third of all rows is shared out too; for
each query a piece returns the rows that can be among the best k by their bounds, never all
pairs. Those that still can when all pieces are seen are ranked by exact cosines of the
original vectors. Queries that meet fewer than k rows look again under more axes, in the end
under all axes of one table, where every row is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import written

TABLES, PROBES = 8, 10
#: Bytes of a vector's name.
NAME = 16
PIECE_ROWS = 4096


def rotations(dim: int, tables: int, seed: int = 7) -> np.ndarray:
    """Random signs for three rounds of each table, of the next power of two."""
    size = 1 << max(1, (dim - 1).bit_length())
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), size=(tables, 3, size))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Pseudo-rotation of the rows of x by one table's signs."""
    size = signs.shape[1]
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    for s in signs:
        y *= s
        h = 1
        while h < size:
            y = y.reshape(len(x), -1, 2, h)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), size)
            h *= 2
        y /= np.sqrt(size)
    return y


def axes(y: np.ndarray, many: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first: axis i is i, its opposite size + i."""
    both = np.concatenate([y, -y], axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, :many]


def encoded(unit: np.ndarray, x: np.ndarray) -> list[bytes]:
    """Unit vectors as steps of one byte, behind a name of the vector x, the size of a step and a bound of the error's length."""
    step = np.maximum(np.abs(unit).max(axis=1) / 127, 1e-30).astype(np.float32)
    code = np.clip(np.rint(unit / step[:, None].astype(np.float64)), -127, 127).astype(np.int8)
    off = np.sqrt(((unit - code * step[:, None].astype(np.float64)) ** 2).sum(axis=1))
    # Rounded up, with room for the rounding of sums.
    error = np.nextafter((off + 1e-6).astype(np.float32), np.float32(np.inf))
    head = np.stack([step, error], axis=1).astype("<f4")
    names = (hashlib.blake2b(v.tobytes(), digest_size=NAME).digest() for v in x + 0.0)
    return [n + h.tobytes() + c.tobytes() for n, h, c in zip(names, head, code, strict=True)]


def decoded(column: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Approximate unit vectors, the bounds of their errors, and the vectors' names as two numbers each."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, NAME + 8 + dim)
    head = np.ascontiguousarray(raw[:, NAME : NAME + 8]).view("<f4")
    names = np.ascontiguousarray(raw[:, :NAME]).view("<u8")
    return np.ascontiguousarray(raw[:, NAME + 8 :]).view(np.int8) * head[:, :1].astype(np.float64), head[:, 1].astype(np.float64), names


def _least_of_each(ids: np.ndarray, names: np.ndarray, many: int) -> np.ndarray:
    """Of the rows of each vector those of the ``many`` smallest ids, in order of ids."""
    order = np.lexsort((ids, names[:, 1], names[:, 0]))
    other = np.append(True, (names[order][1:] != names[order][:-1]).any(axis=1))
    order = order[other | np.append(True, ids[order][1:] != ids[order][:-1])]
    other = np.flatnonzero(np.append(True, (names[order][1:] != names[order][:-1]).any(axis=1)))
    place = np.arange(len(order)) - np.repeat(other, np.diff(np.append(other, len(order))))
    order = order[place < many]
    return order[np.argsort(ids[order], kind="stable")]


def _hashed(signs: np.ndarray, dim: int, many: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                x = part.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                original, x = x, x / np.abs(x).max(axis=1)[:, None]  # so that squares neither vanish nor overflow
                unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
                code = np.array([*encoded(unit, original), None], dtype=object)[:-1]
                for t, s in enumerate(signs):
                    found = axes(rotate(unit, s), many)
                    n = found.shape[1]
                    yield pa.record_batch([pa.array(np.repeat(ids, n), pa.int64()), pa.array(np.full(len(ids) * n, t, np.int32)), pa.array(found.reshape(-1).astype(np.int32)), pa.array(np.repeat(code, n), pa.binary())], names=["vec_id", "t", "axis", "code"])

    return run


def _possible(dim: int, k: int):
    """For each query of a piece, the rows whose cosine can be among its k largest there, with bounds."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]]
        if left.num_rows and right.num_rows:
            qid, rid = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
            (q, q_off, _), (r, r_off, names) = decoded(left["code"], dim), decoded(right["code"], dim)
            # Of equal vectors only those of the smallest ids can be among the best: k, and the query's own.
            order = _least_of_each(rid, names, k + 1)
            r, r_off, rid = r[order], r_off[order], rid[order]
            first = np.flatnonzero(np.append(True, rid[1:] != rid[:-1]))
            for at in range(0, len(q), 128):
                own = q[at : at + 128]
                score = np.einsum("qd,rd->qr", own, r)
                # |uv - u'v'| <= |u - u'| + |v - v'| + |u - u'| |v - v'| for unit vectors u, v.
                a, b = q_off[at : at + 128, None], r_off[None]
                off = a + b + a * b
                low, high = score - off, score + off
                if len(first) < len(rid):  # rows that share an id count once
                    low, high = np.maximum.reduceat(low, first, axis=1), np.maximum.reduceat(high, first, axis=1)
                ids = rid[first]
                same = qid[at : at + 128, None] == ids[None]
                low, high = np.where(same, -np.inf, low), np.where(same, -np.inf, high)
                least = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(own), -np.inf)
                row, col = np.nonzero((high >= least[:, None]) & ~same)
                parts.append([qid[at : at + 128][row], ids[col], low[row, col], high[row, col]])
        a, b, c, d = (np.concatenate([p[i] for p in parts]) for i in range(4))
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "low": pa.array(c, pa.float64()), "high": pa.array(d, pa.float64())})

    return run


def _cosines(dim: int):
    """Exact cosines of the vectors own and asked; each is scaled by its largest component first."""

    def scaled(column: pa.Array) -> np.ndarray:
        x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        return x / np.abs(x).max(axis=1)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = scaled(b.column("own")), scaled(b.column("asked"))
            score = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
            yield pa.record_batch([b.column("query_id"), b.column("vec_id"), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def _ranked(rows: DataFrame, queries: DataFrame, dim: int, k: int, signs: np.ndarray, probes: int, piece_rows: int) -> DataFrame:
    """The best k of the rows that each query meets under so many axes of each table."""
    schema = "vec_id long, t int, axis int, code binary"
    filed = rows.mapInArrow(_hashed(signs, dim, 1), schema)
    asked = queries.mapInArrow(_hashed(signs, dim, probes), schema)
    # Tables times axes rows, whatever the input's size.
    sizes = F.broadcast(filed.groupBy("t", "axis").agg(F.ceil(F.count("*") / piece_rows).cast("long").alias("pieces")))
    filed = filed.join(sizes, ["t", "axis"]).withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces"))).drop("pieces")
    asked = asked.join(sizes, ["t", "axis"]).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).drop("pieces")
    keys = ["t", "axis", "piece"]
    found = asked.groupBy(keys).cogroup(filed.groupBy(keys)).applyInArrow(_possible(dim, k), "query_id long, vec_id long, low double, high double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    # Whoever is above the k-th lower bound may be among the best.
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))
    sure = F.min(F.when(F.col("place") <= k, F.col("low"))).over(Window.partitionBy("query_id"))
    left = once.withColumn("place", place).withColumn("sure", sure).where(F.col("high") >= F.col("sure")).select("query_id", "vec_id")
    exact = left.join(rows.withColumnRenamed("vec", "own"), "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("asked")), "query_id")
    best = exact.select("query_id", "vec_id", "own", "asked").mapInArrow(_cosines(dim), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, probes: int = PROBES, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The k rows of largest cosine found for each query, nearest first, ties to the smaller id.

    A query has k rows, or all others if there are fewer: while it has not, its probes are
    widened, and the last round looks at all rows.

    rows, queries: vec_id long, embedding array of numbers; other columns are not read.
    Vectors that are null, empty or zero, that hold null or non-finite components, or whose
    length is not the most common one (of several, the longest), take no part, nor do rows
    with a null id. Rows that share an id count once, with the nearest of them. Returns
    query_id, rank (from 1), vec_id, score.
    """

    def clean(df: DataFrame) -> DataFrame:
        x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
        fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & fine)

    rows, queries = clean(rows), clean(queries)
    common = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    dim = common["dim"]
    signs = rotations(dim, tables)
    rows, queries = rows.where(F.size("vec") == dim), queries.where(F.size("vec") == dim)
    every = 2 * signs.shape[2]
    probes = min(probes, every)
    found = written(_ranked(rows, queries, dim, k, signs, probes, piece_rows))
    while probes < every:
        full = found.where(F.col("rank") == k).select("query_id")
        short = written(queries.join(full, F.col("vec_id") == F.col("query_id"), "left_anti"))
        if short.isEmpty():
            break
        probes = min(4 * probes, every)
        # Under all axes of a single table are all rows.
        again = _ranked(rows, short, dim, k, signs if probes < every else signs[:1], probes, piece_rows)
        found = written(found.join(full, "query_id", "left_semi").unionByName(again))
    return found
