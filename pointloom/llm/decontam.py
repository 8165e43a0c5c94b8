"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items. For each pattern length m there is a
shift table by the hash of a block of two words (one word where m is 1): how far a cursor
may move when that block ends at it. Where the shift is 0, the block's bucket lists the
patterns that end with it; those whose first block agrees too are compared with the text,
word by word, by both names of each word (128 bits).
The cursors of many stretches of text advance together as arrays.

The tables of one search hold a bounded number of patterns. A benchmark with more is cut
into parts, each searched by itself; the hits of a document are then brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import text as T
from .text import U64

#: Words of benchmark text that one search's tables are made of; they take some 100 bytes a word.
PART_WORDS = 500_000
STRETCH = 512
RESULT = "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start:long,stop:long>>"


class Search:
    """Tables for patterns of one length; ``patterns`` and ``others`` have a row of first and second word names for each."""

    def __init__(self, patterns: np.ndarray, others: np.ndarray):
        self.m = m = patterns.shape[1]
        self.others = others
        self.block = min(2, m)
        self.patterns = patterns
        bits = max(16, int(np.ceil(np.log2(max(1, patterns.size) * 8))))
        self.down = U64(64 - bits)
        self.shift = np.full(1 << bits, m - self.block + 1, dtype=np.uint8 if m < 255 else np.int32)
        for end in range(self.block, m + 1):
            h = self._hash(patterns[:, end - self.block], patterns[:, end - 1])
            np.minimum.at(self.shift, h >> self.down, self.shift.dtype.type(m - end))
        last = self._hash(patterns[:, -self.block], patterns[:, -1])
        self.order = np.argsort(last, kind="stable")
        self.bucket, counts = np.unique(last, return_counts=True)
        self.to = np.concatenate([[0], np.cumsum(counts)])
        self.first = self._hash(patterns[:, 0], patterns[:, self.block - 1])

    def _hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return T.mix(a * U64(3) + b) if self.block == 2 else T.mix(b)

    def find(self, words: np.ndarray, others: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word index, pattern) of all occurrences inside the documents given by offsets."""
        m, at, stop = self.m, [], []
        lo, hi = offsets[:-1] + m - 1, offsets[1:]
        lo, hi = lo[hi > lo], hi[hi > lo]
        pieces = (hi - lo + STRETCH - 1) // STRETCH
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = np.repeat(lo, pieces) + k * STRETCH
        stop = np.minimum(at + STRETCH, np.repeat(hi, pieces))
        ends = [np.zeros(0, np.int64)]
        back = self.block - 1
        while len(at):
            step = self.shift[self._hash(words[at - back], words[at]) >> self.down].astype(np.int64)
            zero = step == 0
            if zero.any():
                ends.append(at[zero])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return self._compare(words, others, np.concatenate(ends))

    def _compare(self, words: np.ndarray, others: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, back = self.m, self.block - 1
        last = self._hash(words[ends - back], words[ends])
        place = np.minimum(np.searchsorted(self.bucket, last), len(self.bucket) - 1)
        known = self.bucket[place] == last if len(self.bucket) else np.zeros(len(ends), bool)
        ends, place = ends[known], place[known]
        first = self._hash(words[ends - m + 1], words[ends - m + 1 + back])
        sizes = self.to[place + 1] - self.to[place]
        starts, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        a, total = 0, np.cumsum(sizes)
        while a < len(ends):  # a bounded number of comparisons at once
            z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + 1_000_000, side="right")))
            n = sizes[a:z]
            row = np.repeat(np.arange(a, z), n)
            pattern = self.order[np.repeat(self.to[place[a:z]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            same = self.first[pattern] == first[row]
            row, pattern = row[same], pattern[same]
            start = ends[row] - m + 1
            for j in range(m):
                same = (words[start + j] == self.patterns[pattern, j]) & (others[start + j] == self.others[pattern, j])
                start, pattern = start[same], pattern[same]
            starts.append(start)
            which.append(pattern)
            a = z
        return np.concatenate(starts), np.concatenate(which)


def build(items: list[tuple[int, str | None]], window: int) -> list[tuple[Search, np.ndarray, np.ndarray]]:
    """For each pattern length: its search, and the items of each pattern as bounds and ids."""
    ids = np.array([k for k, _ in items], dtype=np.int64)
    w = T.words(*T.buffers(pa.array([x for _, x in items], pa.string())), T.ALNUM, lower=True)
    n = w.counts()
    out = []
    for m in sorted({min(int(x), window) for x in n if x}):
        own = np.flatnonzero(n >= window) if m == window else np.flatnonzero(n == m)
        many = n[own] - m + 1
        start = np.repeat(w.offsets[:-1][own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = start[:, None] + np.arange(m)
        found, place = np.unique(np.concatenate([w.hashes[at], w.others[at]], axis=1), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([place.reshape(-1), np.repeat(ids[own], many)], axis=1), axis=0)
        out.append((Search(np.ascontiguousarray(found[:, :m]), np.ascontiguousarray(found[:, m:])), np.searchsorted(pairs[:, 0], np.arange(len(found) + 1)), pairs[:, 1]))
    return out


def _hits(tables, words: np.ndarray, others: np.ndarray, offsets: np.ndarray):
    """(document, first word, end) of occurrences, and distinct (document, item)."""
    spans, items = [np.zeros((0, 3), np.int64)], [np.zeros((0, 2), np.int64)]
    for search, bounds, ids in tables:
        start, pattern = search.find(words, others, offsets)
        doc = np.searchsorted(offsets, start, side="right") - 1
        spans.append(np.stack([doc, start - offsets[doc], start - offsets[doc] + search.m], axis=1))
        pairs = np.unique(np.stack([doc, pattern], axis=1), axis=0)
        n = bounds[pairs[:, 1] + 1] - bounds[pairs[:, 1]]
        which = np.repeat(bounds[pairs[:, 1]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        items.append(np.stack([np.repeat(pairs[:, 0], n), ids[which]], axis=1))
    return np.concatenate(spans), np.unique(np.concatenate(items), axis=0)


def _result(ids: np.ndarray, offsets: np.ndarray, spans: np.ndarray, items: np.ndarray) -> pa.RecordBatch:
    n, total = len(ids), int(offsets[-1])
    marks = np.zeros(total + 1, dtype=np.int64)
    np.add.at(marks, offsets[spans[:, 0]] + spans[:, 1], 1)
    np.add.at(marks, offsets[spans[:, 0]] + spans[:, 2], -1)
    hit = np.cumsum(marks)[:total] > 0
    head = np.zeros(total + 1, dtype=bool)
    head[offsets] = True
    begin = hit & (np.append(True, ~hit[:-1]) | head[:total]) if total else hit
    end = hit & (np.append(~hit[1:], True) | head[1:]) if total else hit
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    doc = np.searchsorted(offsets, first, side="right") - 1
    n_hit = np.bincount(doc, weights=last - first, minlength=n).astype(np.int64)
    pairs = pa.StructArray.from_arrays([pa.array(first - offsets[doc]), pa.array(last - offsets[doc])], names=["start", "stop"])
    lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(n + 1)), pa.int32()), v) for d, v in ((items[:, 0], pa.array(items[:, 1])), (doc, pairs))]
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.diff(offsets)), pa.array(n_hit), *lists], names=["doc_id", "n_words", "n_hit", "items", "spans"])


def _by_part(spans: np.ndarray, items: np.ndarray) -> bytes:
    return B.dump(s0=spans[:, 0], s1=spans[:, 1], s2=spans[:, 2], i0=items[:, 0], i1=items[:, 1])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, part_words: int = PART_WORDS) -> DataFrame:
    """Find the words of documents that lie in windows of benchmark items.

    docs: doc_id long, text string; benchmark: item_id long, text string; other columns are
    not read. An item of fewer words than the window is one window. Returns for each
    document doc_id, n_words, n_hit (words in occurrences), items (ids with an occurrence,
    ascending) and spans (hit stretches, in words). Null and empty texts have no words; rows
    with a null id go; repeated documents are judged each for itself, repeated items count
    once; an empty benchmark hits nothing.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    listed = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    parts: list[list[tuple[int, str]]] = [[]]
    size = 0
    chunked = None
    # Items come to the driver one by one; a part's tables are sent out before the next part is read.
    spark = docs.sparkSession
    found: list[DataFrame] = []

    def search(part):
        tables = spark.sparkContext.broadcast(build(part, window))

        def run(chunk: int, body: bytes, part_no: int = len(found)) -> pa.RecordBatch:
            _, data, offs = B.unpack_chunk(body)
            return B.rows([(chunk, "hits", part_no, _by_part(*_hits(tables.value, *T.all_names(data, offs, T.ALNUM, lower=True))))])

        return run

    for row in listed.toLocalIterator():
        cost = len(row.text) // 2 + 1  # words take two characters at least
        if size and size + cost > part_words:
            chunked = chunked if chunked is not None else B.chunks(docs)
            found.append(B.by_row(chunked, search(parts[-1])))
            parts, size = [[]], 0
        parts[-1].append((row.item_id, row.text))
        size += cost
    if chunked is not None:
        found.append(B.by_row(chunked, search(parts[-1])))

        def together(_: int, got: dict) -> pa.RecordBatch:
            ids, data, offs = B.unpack_chunk(got["text"][-1])
            _, offsets = T.all_words(data, offs, T.ALNUM, lower=True)
            each = [B.load(x) for x in got["hits"].values()]
            spans = np.concatenate([np.stack([x["s0"], x["s1"], x["s2"]], axis=1) for x in each])
            items = np.unique(np.concatenate([np.stack([x["i0"], x["i1"]], axis=1) for x in each]), axis=0)
            return _result(ids, offsets, spans, items)

        return B.by_chunk([chunked, *found], together, RESULT)
    tables = spark.sparkContext.broadcast(build(parts[-1], window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = T.buffers(b.column("text"))
            for a, z in T.slices(offs, B.CHUNK_BYTES):
                found = T.all_names(*T.of_range(data, offs, a, z), T.ALNUM, lower=True)
                yield _result(b.column("doc_id").to_numpy(zero_copy_only=False)[a:z], found[-1], *_hits(tables.value, *found))
                T.trim()

    return picked.mapInArrow(run, RESULT)


def digest(found: DataFrame) -> DataFrame:
    """The result as counts and a digest of the items."""
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
