"""Binary PLY files as a Spark data source, and a sink with 30-byte records."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .files import read_at
from .las import COLUMNS, RECORDS, PartWriter, _ordered, _Part, _Wrote, save_projection

# PLY's number types, the record of the sink, its grey.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2",
    "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8",
}
RECORD = np.dtype([("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("red", "u1"), ("green", "u1"), ("blue", "u1"), ("classification", "u1"), ("treeid", "<u2")])
NAMES = {"<f8": "double", "u1": "uchar", "|u1": "uchar", "<u2": "ushort"}
GREY, HEAD = 218, 4096


@dataclass(frozen=True)
class PlyInfo:
    count: int
    offset: int
    layout: np.dtype


def ply_info(path: str) -> PlyInfo:
    """Header of a little-endian file whose vertices come first and have plain properties."""
    raw = read_at(path, 0, HEAD)
    end = raw.find(b"end_header\n")
    if not raw.startswith(b"ply") or end < 0:
        raise ValueError(f"{path}: no PLY header within {HEAD} bytes")
    lines = raw[:end].decode("ascii", "replace").splitlines()
    if "format binary_little_endian 1.0" not in lines:
        raise ValueError(f"{path}: only binary little-endian files are supported")
    elements = [k for k, x in enumerate(lines) if x.startswith("element ")]
    if not elements or not (m := re.fullmatch(r"element vertex (\d+)", lines[elements[0]])):
        raise ValueError(f"{path}: vertices must come first")
    until = elements[1] if len(elements) > 1 else len(lines)
    fields = []
    for x in lines[elements[0] + 1 : until]:
        if x.startswith("property "):
            parts = x.split()
            if parts[1] not in TYPES:
                raise ValueError(f"{path}: property type {parts[1]} is not supported")
            fields.append((parts[2], TYPES[parts[1]]))
    layout = np.dtype(fields)
    if not {"x", "y", "z"} <= set(layout.names or ()):
        raise ValueError(f"{path}: no x, y, z")
    return PlyInfo(int(m[1]), end + len(b"end_header\n"), layout)


class PlyReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.records = int(options.get("recordsperpartition", RECORDS))
        self.info = ply_info(self.path)

    def partitions(self) -> list[InputPartition]:
        n = self.info.count
        return [_Part(self.path, k, at, min(self.records, n - at)) for k, at in enumerate(range(0, n, self.records))] or [_Part(self.path, 0, 0, 0)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        size = self.info.layout.itemsize
        a = np.frombuffer(read_at(part.path, self.info.offset + part.first * size, part.many * size), self.info.layout)
        keep = np.isfinite(a["x"]) & np.isfinite(a["y"]) & np.isfinite(a["z"])
        n = len(a)
        got = {"ord": np.arange(part.first, part.first + n), "chunk_id": np.full(n, part.chunk, np.int32)}
        got |= {f"o{k}": a[k].astype(np.float64) for k in "xyz"}
        for k, kind in (("red", np.int16), ("green", np.int16), ("blue", np.int16), ("classification", np.int16), ("treeid", np.int32)):
            if k in (a.dtype.names or ()):
                got[k] = a[k].astype(kind)
        none = {"treeid": pa.int32()}
        columns = [pa.array(got[f][keep]) if f in got else pa.nulls(int(keep.sum()), none.get(f, pa.int16())) for f in self.schema.names]
        yield pa.record_batch(columns, names=self.schema.names)


class PlyWriter(PartWriter):
    def encode(self, batch: pa.RecordBatch):
        out = np.zeros(batch.num_rows, RECORD)
        for n in "xyz":
            out[n] = batch.column(f"o{n}").to_numpy(zero_copy_only=False)
        for n in ("red", "green", "blue"):
            out[n] = batch.column(n).fill_null(GREY).to_numpy(zero_copy_only=False) if n in batch.schema.names else GREY
        for n in ("classification", "treeid"):
            out[n] = batch.column(n).to_numpy(zero_copy_only=False)
        return out.tobytes(), [0, 0, 0], [0, 0, 0]

    def head(self, messages: list[_Wrote]) -> bytes:
        lines = ["ply", "format binary_little_endian 1.0", f"element vertex {sum(m.count for m in messages)}"]
        lines += [f"property {NAMES[RECORD[n].str]} {n}" for n in RECORD.names]
        return ("\n".join([*lines, "end_header"]) + "\n").encode()


class PlySource(DataSource):
    """spark.read.format("ply").load(path); option recordsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> DataSourceReader:
        return PlyReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> PlyWriter:
        return PlyWriter(dict(self.options))


def read_ply(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(PlySource)
    return spark.read.format("ply").options(**options).load(path)


def write_ply(points: DataFrame, path: str, label_no: int | None = None) -> None:
    """Write all points in order of ord; those without a colour are grey."""
    points.sparkSession.dataSource.register(PlySource)
    rows = save_projection(points, label_no)
    if not rows.where("classification not between 0 and 255 or treeid not between 0 and 65535").isEmpty():
        raise ValueError("classes are 0 to 255, trees 0 to 65535")
    _ordered(rows).write.format("ply").mode("append").options(run=uuid.uuid4().hex, count=rows.count()).save(path)


def read_cloud(spark: SparkSession, path: str, **options) -> DataFrame:
    """A .las file as LAS, anything else as PLY."""
    from .las import read_las

    return (read_las if path.lower().endswith(".las") else read_ply)(spark, path, **options)


def scan_box(points: DataFrame) -> DataFrame:
    """Box of the original coordinates; no finite point is an error."""
    box = points.agg(*[f(f"o{n}").alias(f"{f.__name__}_{n}") for n in "xyz" for f in (F.min, F.max)])
    if box.first()["min_x"] is None:
        raise ValueError("no finite point")
    return box
