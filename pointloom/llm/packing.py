"""Best-fit packing of tokenised documents by the linear grouping scheme.

The plan is made from the number of pieces of each length alone, at most ``capacity``
numbers however large the corpus is. Long pieces, in order of length, fall into groups of
equal cardinality and count as long as the longest of their group; a linear programme over
the configurations of these few sizes (column generation: its pricing is a knapsack) says
how many sequences of each configuration to make; the pieces take the places of their
group; the rest goes, longest first, where it leaves the least room. The plan is a list of
runs "the pieces of length L ranked r to r+n-1 lie at offset o of sequences q to q+n-1";
each piece then finds its place by its rank among its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import text as T
from .tokens import encoder

CAPACITY = 2048
#: (small, groups): pieces longer than capacity / small are grouped, into so many sizes at most. What is
#: best depends on how many small pieces there are; the plan with fewest sequences is taken.
SETTINGS = ((3, 400), (2, 400), (4, 160))
PIECE = "task long, local long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, by column generation."""
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    level = demand / np.diag(basis)
    inverse = np.diag(1 / np.diag(basis))  # no BLAS calls here: its threads do not survive forks
    for _ in range(20 * n + 50):
        price = inverse.sum(axis=0)
        # Unbounded knapsack: best value and the last size taken, by room.
        best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        order = [k for k in np.argsort(-sizes) if price[k] > 1e-12]
        for k in order:
            w, p = int(sizes[k]), price[k]
            for a in range(w, capacity + 1, w):  # all rooms that take one piece more at once
                z = min(a + w, capacity + 1)
                better = best[a - w : z - w] + p > best[a:z] + 1e-12
                best[a:z] = np.where(better, best[a - w : z - w] + p, best[a:z])
                took[a:z] = np.where(better, k, took[a:z])
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(n), capacity
        while room > 0 and took[room] >= 0:
            column[took[room]] += 1
            room -= int(sizes[took[room]])
        move = (inverse * column).sum(axis=1)
        ratio = np.where(move > 1e-10, level / np.where(move > 1e-10, move, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        step = max(ratio[out], 0.0)
        level = np.maximum(level - step * move, 0)
        level[out] = step
        basis[:, out] = column
        pivot = inverse[out] / move[out]
        inverse = inverse - np.outer(move, pivot)
        inverse[out] = pivot
    return [(basis[:, k].astype(int), float(level[k])) for k in range(n)]


class Plan:
    """Runs of places, by length; total is the number of sequences."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int, int]]] = {}  # length: (first rank, first sequence, offset)
        self.total = 0


def plan(counts: dict[int, int], capacity: int = CAPACITY, settings: tuple = SETTINGS) -> Plan:
    """The plan with fewest sequences over the settings; one that no plan can beat ends the search."""
    bound, best = -(-sum(k * n for k, n in counts.items()) // capacity), None
    for small, groups in settings:
        made = _plan(counts, capacity, small, groups)
        best = made if best is None or made.total < best.total else best
        if best.total <= bound:
            break
    return best


def _plan(counts: dict[int, int], capacity: int, small: float, groups: int) -> Plan:
    out = Plan()
    left = {k: v for k, v in counts.items() if v > 0}
    rank = dict.fromkeys(left, 0)

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        out.runs.setdefault(length, []).append((rank[length], sequence, offset))
        rank[length] += n
        left[length] -= n

    def fresh(n: int) -> int:
        out.total += n
        return out.total - n

    if left.get(capacity):
        place(capacity, left[capacity], fresh(left[capacity]), 0)
    # Open sequences by room: (room, first sequence, how many).
    rooms: list[tuple[int, int, int]] = []
    long = sorted((k for k in left if left[k] and k > capacity / small), reverse=True)
    total = sum(left[k] for k in long)
    if total:
        # Groups of equal cardinality, as [longest, how many]; a length may stand in several.
        size = max(1, -(-total // groups))
        group: list[list] = []
        members: list[list[list[int]]] = []
        for k in long:
            n = left[k]
            while n:
                if not group or group[-1][1] == size:
                    group.append([k, 0])
                    members.append([])
                take = min(n, size - group[-1][1])
                group[-1][1] += take
                members[-1].append([k, take])
                n -= take
        merged: dict[int, list[list[int]]] = {}
        for (top, _), own in zip(group, members, strict=True):
            merged.setdefault(top, []).extend(own)
        sizes = np.array(sorted(merged, reverse=True))
        demand = np.array([sum(n for _, n in merged[k]) for k in sizes], dtype=float)
        for column, level in _configurations(sizes, demand, capacity):
            times = int(level + 1e-9)
            if times < 1 or not column.any():
                continue
            classes = [(fresh(times), times, 0)]  # first sequence, how many, filled
            for g in np.flatnonzero(column):
                queue = merged[sizes[g]]
                for _ in range(column[g]):
                    split = []
                    for first, n, filled in classes:
                        while n and queue:
                            take = min(n, queue[0][1])
                            k = queue[0][0]
                            place(k, take, first, filled)
                            split.append((first, take, filled + k))
                            queue[0][1] -= take
                            if not queue[0][1]:
                                queue.pop(0)
                            first, n = first + take, n - take
                        if n:
                            split.append((first, n, filled))
                    classes = split
            rooms += [(capacity - filled, first, n) for first, n, filled in classes if filled < capacity]
    rooms.sort()
    # Best fit, longest first.
    for k in sorted((k for k in left if left[k]), reverse=True):
        while left[k]:
            at = bisect_left(rooms, (k, -1, -1))
            if at == len(rooms):
                each = capacity // k
                n = -(-left[k] // each)
                insort(rooms, (capacity, fresh(n), n))
                continue
            room, first, n = rooms.pop(at)
            take = min(n, left[k])
            place(k, take, first, capacity - room)
            if room > k:
                insort(rooms, (room - k, first, take))
            if n > take:
                insort(rooms, (room, first + take, n - take))
    return out


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            data, offs = T.buffers(b.column("text"))
            doc_ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for a, z in T.slices(offs):
                ids, bounds = encode(*T.of_range(data, offs, a, z))
                n = np.diff(bounds) + 1
                many = -(-n // capacity)
                doc = np.repeat(np.arange(z - a), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                order = np.argsort(length, kind="stable")
                new = np.append(True, length[order][1:] != length[order][:-1])
                first = np.flatnonzero(new)
                local = np.empty(len(doc), dtype=np.int64)
                local[order] = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc)))) + seen[length[order]]
                seen += np.bincount(length, minlength=capacity + 1)
                # A document's last piece ends with id 0; the others are whole.
                low = bounds[doc] + start
                high = np.minimum(low + length, bounds[doc + 1])
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4").tobytes())
                end = (length - (high - low)).tolist()
                crc = [zlib.crc32(b"\0\0\0\0", zlib.crc32(raw[x:y])) if w else zlib.crc32(raw[x:y]) for x, y, w in zip((4 * low).tolist(), (4 * high).tolist(), end, strict=True)]
                out = [pa.array(np.full(len(doc), task, np.int64)), pa.array(local), pa.array(doc_ids[a:z][doc], pa.int64()), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["task", "local", "doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([[*ids[x:y].tolist(), *[0] * w] for x, y, w in zip(low.tolist(), high.tolist(), end, strict=True)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(out, names=names)
            T.trim()

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, settings: tuple = SETTINGS, with_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as it can.

    docs: doc_id long, text string; other columns are not read. tokenizer: the path of a
    ``tokenizers`` file whose tokens end at white space. A document is its ids and a final
    id 0, so null and empty texts are one token; a longer one than the capacity is cut into
    pieces of that length and a rest. Returns per piece doc_id, piece, start, length,
    ids_crc32, sequence_id, offset (and ids, if with_ids). Rows with a null doc_id go; rows
    that share a doc_id are packed each for itself.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    pieces = B.written(picked.mapInArrow(_pieces(tokenizer, capacity, with_ids), PIECE + ", ids array<int>" * with_ids))
    each = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    made = plan(counts, capacity, settings)
    lengths = np.array(sorted(made.runs), dtype=np.int64)
    # All runs in order of (length, first rank), keyed by one number.
    wide = max(counts.values(), default=0) + 1
    runs = np.array([(k * wide + r, q, o) for k in lengths.tolist() for r, q, o in sorted(made.runs[k])], dtype=np.int64).reshape(-1, 3)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(each.select("length", "task", before.alias("before")), ["length", "task"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("length").to_numpy() * wide + b.column("local").to_numpy() + b.column("before").to_numpy()
            at = np.searchsorted(runs[:, 0], key, side="right") - 1
            told = {"sequence_id": pa.array(runs[at, 1] + key - runs[at, 0]), "offset": pa.array(runs[at, 2])}
            yield pa.record_batch([told[k] if k in told else b.column(k) for k in names], names=names)

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
