"""LAS files as a Spark data source, and a sink that writes LAS 1.2.

A file is read in partitions of whole records, decoded as arrays. ord is the record's
number in the file, so it does not depend on how the file is cut.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .files import locate, read_at, size_of

# The public LAS layout.
FORMATS = (0, 1, 2, 3, 6, 7, 8)
RGB_AT = {2: 20, 3: 28, 7: 30, 8: 30}
LEAST_RECORD = {0: 20, 1: 28, 2: 26, 3: 34, 6: 30, 7: 36, 8: 38}
RECORDS, PROBE = 500_000, 1024
COLUMNS = "chunk_id int, ord long, ox double, oy double, oz double, red smallint, green smallint, blue smallint, classification smallint, treeid int"


@dataclass(frozen=True)
class LasInfo:
    version: tuple[int, int]
    offset: int
    format: int
    record: int
    count: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]
    least: tuple[float, float, float]
    most: tuple[float, float, float]
    rgb_max: int

    @property
    def has_colour(self) -> bool:
        return self.format in RGB_AT


def las_info(path: str, count_policy: str = "standard") -> LasInfo:
    """The header; count_policy 'reference' reads the extended count where some writers put it."""
    head = read_at(path, 0, 375)
    if len(head) < 227 or head[:4] != b"LASF":
        raise ValueError(f"{path}: no LAS file")
    major, minor = head[24], head[25]
    if major != 1:
        raise ValueError(f"{path}: LAS version {major}.{minor} is not supported")
    (header,) = struct.unpack_from("<H", head, 94)
    (offset,) = struct.unpack_from("<I", head, 96)
    kind, (record,), (count,) = head[104] & 0x7F, struct.unpack_from("<H", head, 105), struct.unpack_from("<I", head, 107)
    if kind not in FORMATS:
        raise ValueError(f"{path}: point format {kind} is not supported")
    if record < LEAST_RECORD[kind]:
        raise ValueError(f"{path}: records of {record} bytes are too short for format {kind}")
    if not offset:  # beyond 4 GB some writers put it right behind the header
        (offset,) = struct.unpack("<Q", read_at(path, header, 8))
    if not count and minor >= 4 and len(head) >= 255:
        (count,) = struct.unpack_from("<Q", head, 247 if count_policy == "standard" else 227)
        if not count and count_policy != "standard":
            count = sum(struct.unpack_from("<5I", head, 235))
    if not count:
        count = max(0, size_of(path) - offset) // record
    numbers = struct.unpack_from("<12d", head, 131)
    scale, shift, box = numbers[:3], numbers[3:6], numbers[6:]
    if not all(scale):
        raise ValueError(f"{path}: a scale is 0")
    most, least = (box[0], box[2], box[4]), (box[1], box[3], box[5])
    rgb = 0
    if kind in RGB_AT:
        raw = np.frombuffer(read_at(path, offset, record * min(count, PROBE)), _layout(kind, record))
        rgb = int(max((raw[c].max(initial=0) for c in "rgb"), default=0))
    return LasInfo((major, minor), offset, kind, record, count, scale, shift, least, most, rgb)


def _layout(kind: int, record: int) -> np.dtype:
    new = kind >= 6
    fields = {"x": ("<i4", 0), "y": ("<i4", 4), "z": ("<i4", 8), "class": ("u1", 16 if new else 15), "source": ("<u2", 20 if new else 18)}
    if kind in RGB_AT:
        fields |= {c: ("<u2", RGB_AT[kind] + 2 * k) for k, c in enumerate("rgb")}
    return np.dtype({"names": list(fields), "formats": [f for f, _ in fields.values()], "offsets": [o for _, o in fields.values()], "itemsize": record})


def decode(raw: bytes, info: LasInfo) -> dict[str, np.ndarray]:
    a = np.frombuffer(raw, _layout(info.format, info.record))
    out = {f"o{n}": a[n] * s + t for n, s, t in zip("xyz", info.scale, info.shift, strict=True)}
    out["classification"] = (a["class"] if info.format >= 6 else a["class"] & 0x1F).astype(np.int16)
    out["treeid"] = a["source"].astype(np.int32)
    if info.has_colour:
        for c, n in zip("rgb", ("red", "green", "blue"), strict=True):
            out[n] = (a[c] >> 8 if info.rgb_max >= 256 else a[c]).astype(np.int16)
    return out


class _Part(InputPartition):
    def __init__(self, path: str, chunk: int, first: int, many: int):
        self.path, self.chunk, self.first, self.many = path, chunk, first, many


class LasReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.records = int(options.get("recordsperpartition", RECORDS))
        self.info = las_info(self.path, options.get("countpolicy", "standard"))

    def partitions(self) -> list[InputPartition]:
        n = self.info.count
        return [_Part(self.path, k, at, min(self.records, n - at)) for k, at in enumerate(range(0, n, self.records))] or [_Part(self.path, 0, 0, 0)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        i = self.info
        got = decode(read_at(part.path, i.offset + part.first * i.record, part.many * i.record)[: part.many * i.record], i)
        n = len(got["ox"])
        keep = np.isfinite(got["ox"]) & np.isfinite(got["oy"]) & np.isfinite(got["oz"])
        got |= {"ord": np.arange(part.first, part.first + n), "chunk_id": np.full(n, part.chunk, np.int32)}
        columns = [pa.array(got[f][keep]) if f in got else pa.nulls(int(keep.sum()), pa.int16()) for f in self.schema.names]
        yield pa.record_batch(columns, names=self.schema.names)


#: Coordinates as 32-bit integers.
_MOST = 2**31 - 1


def write_plan(least: tuple, most: tuple) -> tuple[float, tuple]:
    """Scale and offset: 0.001, ten times coarser until the box fits; the offset is the box's centre."""
    shift = tuple((a + b) / 2 for a, b in zip(least, most, strict=True))
    scale = 0.001
    while max((b - a) / 2 for a, b in zip(least, most, strict=True)) / scale > _MOST:
        scale *= 10
    return scale, shift


def header(kind: int, count: int, scale: float, shift: tuple, low: list[int], high: list[int]) -> bytes:
    record = LEAST_RECORD[kind]
    box = [v for k in range(3) for v in (high[k] * scale + shift[k], low[k] * scale + shift[k])]
    out = bytearray(227)
    out[:4] = b"LASF"
    out[24:26] = bytes([1, 2])
    out[26:58], out[58:90] = b"OTHER".ljust(32, b"\0"), b"pointloom".ljust(32, b"\0")
    struct.pack_into("<HIIBHI5I", out, 94, 227, 227, 0, kind, record, count, count, 0, 0, 0, 0)
    struct.pack_into("<12d", out, 131, scale, scale, scale, *shift, *box)
    return bytes(out)


def encode(batch: pa.RecordBatch, kind: int, scale: float, shift: tuple) -> tuple[bytes, list[int], list[int]]:
    out = np.zeros(batch.num_rows, _layout(kind, LEAST_RECORD[kind]))
    col = lambda n: batch.column(n).to_numpy(zero_copy_only=False)
    low, high = [], []
    for n, t in zip("xyz", shift, strict=True):
        # Halves go up.
        v = np.clip(np.floor((col(f"o{n}") - t) / scale + 0.5), -_MOST - 1, _MOST).astype(np.int32)
        out[n] = v
        low.append(int(v.min()))
        high.append(int(v.max()))
    kinds = col("classification")
    if (kinds > 31).any() or (kinds < 0).any():
        raise ValueError("LAS 1.2 holds classes 0 to 31 only")
    out["class"], out["source"] = kinds, col("treeid")
    if kind in RGB_AT:
        for c, n in zip("rgb", ("red", "green", "blue"), strict=True):
            out[c] = col(n).astype(np.uint16) << 8
    raw = bytearray(out.tobytes())
    raw[14 :: LEAST_RECORD[kind]] = bytes([0x09]) * batch.num_rows  # return 1 of 1
    return bytes(raw), low, high


@dataclass
class _Wrote(WriterCommitMessage):
    name: str
    first: int
    count: int
    low: list
    high: list


class PartWriter(DataSourceArrowWriter):
    """Tasks write parts beside the target; the commit puts them together by their first ord.

    Nothing is left of an aborted write, and the target appears only when it is whole.
    """

    def __init__(self, options: dict):
        self.path, self.folder = options["path"], options["path"] + ".parts-" + options["run"]
        self.expected = int(options["count"])

    def encode(self, batch: pa.RecordBatch):
        raise NotImplementedError

    def head(self, messages: list[_Wrote]) -> bytes:
        raise NotImplementedError

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder = locate(self.folder)
        fs.create_dir(folder, recursive=True)
        name = f"{folder}/{uuid.uuid4().hex}"
        first, count, low, high = 2**62, 0, [2**31] * 3, [-(2**31)] * 3
        with fs.open_output_stream(name) as out:
            for b in batches:
                if not b.num_rows:
                    continue
                raw, lo, hi = self.encode(b)
                out.write(raw)
                first, count = min(first, b.column("ord")[0].as_py()), count + b.num_rows
                low, high = [min(x, y) for x, y in zip(low, lo, strict=True)], [max(x, y) for x, y in zip(high, hi, strict=True)]
        return _Wrote(name, first, count, low, high)

    def commit(self, messages: list) -> None:
        told = sorted((m for m in messages if m is not None and m.count), key=lambda m: m.first)
        if sum(m.count for m in told) != self.expected:
            self.abort(messages)
            raise ValueError(f"{self.path}: {sum(m.count for m in told)} points written, {self.expected} expected")
        fs, target = locate(self.path)
        whole = target + ".whole-" + uuid.uuid4().hex
        with fs.open_output_stream(whole) as out:
            out.write(self.head(told))
            for m in told:
                with fs.open_input_stream(m.name) as part:
                    while block := part.read(8 << 20):
                        out.write(block)
        fs.move(whole, target)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, folder = locate(self.folder)
        if fs.get_file_info(folder).is_file is False and fs.get_file_info(folder).type.name == "Directory":
            fs.delete_dir(folder)


class LasWriter(PartWriter):
    def __init__(self, options: dict):
        super().__init__(options)
        self.kind, self.scale = int(options["pointformat"]), float(options["scale"])
        self.shift = tuple(map(float, options["shift"].split(",")))

    def encode(self, batch: pa.RecordBatch):
        return encode(batch, self.kind, self.scale, self.shift)

    def head(self, messages: list[_Wrote]) -> bytes:
        low = [min((m.low[k] for m in messages), default=0) for k in range(3)]
        high = [max((m.high[k] for m in messages), default=0) for k in range(3)]
        return header(self.kind, sum(m.count for m in messages), self.scale, self.shift, low, high)


class LasSource(DataSource):
    """spark.read.format("las").load(path); options recordsPerPartition, countPolicy, columns."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        wanted = self.options.get("columns")
        if not wanted:
            return COLUMNS
        kinds = dict(c.strip().split(" ") for c in COLUMNS.split(","))
        return ", ".join(f"{c.strip()} {kinds[c.strip()]}" for c in wanted.split(","))

    def reader(self, schema: StructType) -> DataSourceReader:
        return LasReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> LasWriter:
        return LasWriter(dict(self.options))


def read_las(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(LasSource)
    return spark.read.format("las").options(**options).load(path)


def save_projection(points: DataFrame, label_no: int | None = None) -> DataFrame:
    """The columns that files hold; an entity's number overrides the tree of its points."""
    tree = F.coalesce(F.lit(label_no).cast("int"), F.col("treeid"), F.lit(0))
    colour = [F.col(c) for c in ("red", "green", "blue") if c in points.columns]
    return points.select("ord", "ox", "oy", "oz", *colour, F.coalesce("classification", F.lit(0)).cast("smallint").alias("classification"), tree.cast("int").alias("treeid"))


def write_las(points: DataFrame, path: str, label_no: int | None = None) -> None:
    """Write all points in order of ord; classes above 31 are refused before anything is written."""
    points.sparkSession.dataSource.register(LasSource)
    rows = save_projection(points, label_no)
    colour = "red" in rows.columns
    facts = rows.agg(F.count("*").alias("n"), F.max("classification").alias("c"), F.count_if(F.col("red").isNotNull()).alias("coloured") if colour else F.lit(0).alias("coloured"), *[f(f"o{k}").alias(f"{f.__name__}_{k}") for k in "xyz" for f in (F.min, F.max)]).first()
    if facts["n"] and facts["c"] > 31:
        raise ValueError(f"class {facts['c']} does not fit LAS 1.2")
    colour = colour and facts["coloured"] == facts["n"] and facts["n"] > 0
    least, most = (tuple(facts[f"{f}_{k}"] or 0.0 for k in "xyz") for f in ("min", "max"))
    if not all(map(math.isfinite, least + most)):
        raise ValueError("coordinates must be finite")
    scale, shift = write_plan(least, most)
    options = {"run": uuid.uuid4().hex, "count": facts["n"], "pointFormat": 3 if colour else 0, "scale": repr(scale), "shift": ",".join(map(repr, shift))}
    _ordered(rows if colour else rows.drop("red", "green", "blue")).write.format("las").mode("append").options(**options).save(path)


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange("ord").sortWithinPartitions("ord")
