"""Packed arrays, chunks of documents, and the exchange of packed blocks.

Several operators ask a global question about every word, symbol or n-gram of the corpus
("in which other document does this occur?"). One Spark row per item would cost far more
than the text itself. So documents are gathered into chunks of bounded size; a chunk sends
each of its distinct items once, sorted and packed, in one block per bucket; the task that
owns a bucket merges the blocks and answers each with an array in the block's order. A hot
item is thus sent once by each chunk, however often it occurs, and no task gets a group of
rows that grows with one key. When chunks and buckets are so many that a block holds a
single item, this is an ordinary shuffle of pre-aggregated rows.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from . import text as T

#: Bytes of text in a chunk (one document may be longer).
CHUNK_BYTES = 8 << 20
BLOCK = "chunk long, kind string, bucket long, body binary"
_ARROW = pa.schema([("chunk", pa.int64()), ("kind", pa.string()), ("bucket", pa.int64()), ("body", pa.binary())])


def dump(**arrays: np.ndarray) -> bytes:
    """Pack one-dimensional arrays by byte planes; names that begin with ``sorted`` as differences."""
    head, parts = [], []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head.append([name, a.dtype.str, len(a)])
        if name.startswith("sorted") and len(a):
            a = np.diff(a, prepend=a.dtype.type(0))
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"")
    text = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", len(text)) + text + b"".join(parts))


def load(body: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    (size,) = struct.unpack_from("<I", raw)
    at, out = 4 + size, {}
    for name, kind, n in json.loads(raw[4:at]):
        kind = np.dtype(kind)
        width = n * kind.itemsize
        planes = np.frombuffer(raw, np.uint8, width, at).reshape(kind.itemsize, n)
        a = np.ascontiguousarray(planes.T).reshape(-1).view(kind) if n else np.zeros(0, kind)
        out[name] = np.cumsum(a, dtype=kind) if name.startswith("sorted") and n else a
        at += width
    return out


def rows(found: list[tuple[int, str, int, bytes]]) -> pa.RecordBatch:
    chunk, kind, bucket, body = zip(*found, strict=True) if found else ((), (), (), ())
    return pa.record_batch([pa.array(chunk, pa.int64()), pa.array(kind, pa.string()), pa.array(bucket, pa.int64()), pa.array(body, pa.binary())], schema=_ARROW)


#: Bytes of packed chunks that a bucket of an exchange answers for, about.
BUCKET_BYTES = 32 << 20


def buckets(parts: DataFrame) -> int:
    """Buckets of an exchange of the chunks: one for each BUCKET_BYTES of them, and two for each shuffle partition at least."""
    size = int(str(parts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the written files
    return max(2 * int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def _pack_chunks(limit: int, extra: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, seq
            table = pa.Table.from_batches(held).combine_chunks()
            texts = table["__text"].combine_chunks()
            data, offs = T.buffers(texts)
            parts = [dump(doc_id=table["__id"].to_numpy(), lengths=np.diff(offs)), zstandard.ZstdCompressor(level=3).compress(data.tobytes())]
            if extra:
                sink = pa.BufferOutputStream()
                more = table.drop_columns(["__id", "__text"])
                with pa.ipc.new_stream(sink, more.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(more)
                parts.append(sink.getvalue().to_pybytes())
            body = b"".join(struct.pack("<I", len(x)) + x for x in parts)
            held, size, seq = [], 0, seq + 1
            return rows([(base + seq, "text", -1, body)])

        for b in batches:
            _, offs = T.buffers(b.column("__text"))
            at = 0
            while at < b.num_rows:
                room = max(1, int(np.searchsorted(offs, offs[at] + limit - size, side="right")) - 1 - at)
                part = b.slice(at, min(room, b.num_rows - at))
                held.append(part)
                size += int(offs[at + part.num_rows] - offs[at])
                at += part.num_rows
                if size >= limit or at < b.num_rows:
                    yield flush()
        if held:
            yield flush()

    return run


def chunks(docs: DataFrame, limit: int = CHUNK_BYTES, extra: bool = False) -> DataFrame:
    """Documents gathered into written chunk rows; null ids go. extra: with all columns but text."""
    more = [F.col(f"`{k}`") for k in docs.columns if k != "text"] if extra else []
    picked = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("__text"), *more)
    return written(picked.mapInArrow(_pack_chunks(limit, extra), BLOCK))


def _part(body: bytes, k: int) -> bytes:
    at = 0
    for _ in range(k):
        at += 4 + struct.unpack_from("<I", body, at)[0]
    return body[at + 4 : at + 4 + struct.unpack_from("<I", body, at)[0]]


def unpack_chunk(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, text bytes and offsets of a chunk."""
    head = load(_part(body, 0))
    offs = np.concatenate([[0], np.cumsum(head["lengths"])]).astype(np.int64)
    raw = zstandard.ZstdDecompressor().decompress(_part(body, 1))
    return head["doc_id"], np.frombuffer(raw, np.uint8), offs


def unpack_extra(body: bytes) -> pa.RecordBatch:
    """The other columns of a chunk."""
    with pa.ipc.open_stream(_part(body, 2)) as stream:
        return stream.read_all().combine_chunks().to_batches()[0]


def by_row(df: DataFrame, fn: Callable, schema: str = BLOCK) -> DataFrame:
    """fn(chunk, body) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, body in zip(b.column("chunk").to_pylist(), b.column("body"), strict=True):
                yield fn(chunk, body.as_py())
                T.trim()

    return df.mapInArrow(run, schema)


def by_bucket(df: DataFrame, fn: Callable) -> DataFrame:
    """fn(table) -> record batch for all rows of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        out = pa.Table.from_batches([fn(table)])
        T.trim()
        return out

    return df.groupBy("bucket").applyInArrow(run, BLOCK)


def by_chunk(frames: list[DataFrame], fn: Callable, schema: str = BLOCK) -> DataFrame:
    """fn(chunk, {kind: {bucket: body}}) for all rows of a chunk."""
    df = frames[0]
    for more in frames[1:]:
        df = df.unionByName(more)

    def run(table: pa.Table) -> pa.Table:
        found: dict[str, dict[int, bytes]] = {}
        for kind, bucket, body in zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["body"].to_pylist(), strict=True):
            found.setdefault(kind, {})[bucket] = body
        out = pa.Table.from_batches([fn(table["chunk"][0].as_py(), found)])
        T.trim()
        return out

    return df.groupBy("chunk").applyInArrow(run, schema)


def slim(a: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on, in as few bytes each as they fit in."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def split(keys: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the n buckets in sorted keys.

    A bucket is a range of the 64-bit key space, so sorted keys are in the buckets' order too.
    """
    edges = np.array([(k << 64) // n for k in range(1, n)], dtype=np.uint64)
    cut = np.searchsorted(keys, edges, side="left")
    return np.concatenate([[0], cut, [len(keys)]])
