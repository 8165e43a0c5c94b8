"""Toxicity by compression distance.

zstandard trains two dictionaries on a bounded sample of labelled texts: one on ordinary
text, one on toxic text. A window of a text is compressed with the ordinary dictionary and
with both (the toxic one before the ordinary one); what the toxic one saves is a sign of
toxicity. Most of a toxic text is ordinary, so the toxic dictionary is trained in rounds: at
first on all windows of toxic texts, then on those that dictionaries of other texts compress
better with toxic text than all but a few windows of ordinary texts. The savings over all
windows of a text are summed up by a few features, and a logistic curve that is calibrated on
labelled texts which the dictionaries have not seen turns them into a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as z
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from . import text as T

#: The sample that the model is fitted on: at most so many labelled rows of each label, in the
#: order of a hash of the id, so many bytes of text of each label, and so many of one row. Rows
#: beyond these bounds are left out whole; no text is cut.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 16 << 20
ROW_BYTES = 1 << 20
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: The column that score() adds.
SCORE = "__toxicity"
#: Words in a window, by feature group.
WINDOWS = (8, 16)
#: Dictionaries: bytes at most, words of a training window, and zstandard's segment and key sizes.
ORDINARY, TOXIC = (512 << 10, 64, 64, 8), (8 << 10, 4, 16, 8)
#: Rounds of the toxic dictionary, and the share of ordinary windows that a training window has to exceed.
ROUNDS, BEYOND = 4, 0.95
#: Labelled texts of either label that a model needs.
FEWEST = 8
LEVEL = 9


def _prepared(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes, with a space for each separator, and offsets; a space stands before each text."""
    data = T.LOWER[np.frombuffer(b"".join(b" " + x for x in texts), np.uint8)] if texts else np.zeros(0, np.uint8)
    return np.where(T.SPACED[data], data, 0x20).astype(np.uint8), np.cumsum([0, *[len(x) + 1 for x in texts]])


@dataclass
class _Windows:
    """Windows of a few words: where they begin and end, with the space before them, and in which text."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offs: np.ndarray, size: int) -> _Windows:
        starts, ends, at = T.spans(data, offs, T.SPACED)
        words = np.diff(at)
        many = -(-words // size)
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        doc = np.repeat(np.arange(len(words)), many)
        a = at[:-1][doc] + k * size
        b = np.minimum(a + size, at[1:][doc]) - 1
        return cls(data.tobytes(), np.maximum(starts[a] - 1, 0), ends[b], doc)

    def __len__(self) -> int:
        return len(self.doc)

    def some(self, which: np.ndarray) -> _Windows:
        return _Windows(self.data, self.starts[which], self.ends[which], self.doc[which])

    def sizes(self, tool: z.ZstdCompressor) -> np.ndarray:
        """Compressed lengths."""
        if not len(self):
            return np.zeros(0, np.int64)
        spans = np.stack([self.starts, self.ends - self.starts], axis=1).astype(np.uint64)
        return np.fromiter(map(len, tool.multi_compress_to_buffer(z.BufferWithSegments(self.data, spans.tobytes()), threads=1)), np.int64, len(self))

    def dictionary(self, size: int, words: int, segment: int, key: int) -> bytes:
        """Trained by zstandard; where the windows are too few for that, the windows themselves, as far as they fit.

        Each different window counts once, in the order of a hash: the trainer stops at a
        stretch that brings nothing new, as a long text that repeats itself would be.
        """
        texts = sorted({self.data[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)}, key=lambda x: (zlib.crc32(x), x))
        try:
            return z.train_dictionary(size, [x for x in texts if len(x) >= 8], k=segment, d=key).as_bytes()
        except (z.ZstdError, ValueError):
            return b"".join(texts)[:size]


def _tool(body: bytes) -> z.ZstdCompressor:
    p = z.ZstdCompressionParameters.from_level(LEVEL, source_size=128, dict_size=len(body), format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    d = z.ZstdCompressionDict(body, dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return z.ZstdCompressor(dict_data=d, compression_params=p)


def _dictionaries(ordinary: list[bytes], toxic: list[bytes]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary.

    A round's training windows are chosen by dictionaries that were trained on the texts of
    the other half, so that no window is chosen for what it alone repeats.
    """
    plain, marked = _prepared(ordinary), _prepared(toxic)
    long, short, own = _Windows.of(*plain, ORDINARY[1]), _Windows.of(*plain, TOXIC[1]), _Windows.of(*marked, TOXIC[1])
    base = long.dictionary(*ORDINARY)
    chosen = np.ones(len(own), dtype=bool)
    halves = []
    for half in (0, 1):
        other = long.some(long.doc % 2 != half).dictionary(*ORDINARY)
        tool, mine, rival = _tool(other), own.some(own.doc % 2 == half), short.some(short.doc % 2 == half)
        halves.append((other, mine, mine.sizes(tool), rival, rival.sizes(tool)))
    for _ in range(ROUNDS - 1):
        after = np.zeros(len(own), dtype=bool)
        for half, (other, mine, mine_sizes, rival, rival_sizes) in enumerate(halves):
            tool = _tool(own.some(chosen & (own.doc % 2 != half)).dictionary(*TOXIC) + other)
            usual = rival_sizes - rival.sizes(tool)
            after[own.doc % 2 == half] = mine_sizes - mine.sizes(tool) > (np.quantile(usual, BEYOND) if len(usual) else 0)
        if after.sum() < FEWEST:
            break
        chosen = after
    return base, own.some(chosen).dictionary(*TOXIC)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def compressors(self) -> list[z.ZstdCompressor]:
        return [_tool(self.toxic + self.ordinary), _tool(self.ordinary)]

    def features(self, data: np.ndarray, offs: np.ndarray, tools: list[z.ZstdCompressor]) -> np.ndarray:
        """Features of each text; those of texts without words are 0."""
        n = len(offs) - 1
        out = []
        for size in WINDOWS:
            w = _Windows.of(data, offs, size)
            gain = (w.sizes(tools[1]) - w.sizes(tools[0])).astype(float)
            order = np.lexsort((-gain, w.doc))
            gain, doc = gain[order], w.doc[order]
            many = np.bincount(doc, minlength=n)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            many_f = np.maximum(many, 1)
            for top in (1, 3, 6):
                out.append(np.bincount(doc, np.where(k < top, gain, 0), n) / top)
            total = np.bincount(doc, gain, n)
            out += [total / many_f, total / np.sqrt(many_f)]
        return np.stack(out, axis=1)

    def scores(self, data: np.ndarray, offs: np.ndarray, tools) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(offs) - 1, self.prior)
        x = (self.features(data, offs, tools) - self.center) / self.scale
        t = self.weights[0] + (x * self.weights[1:]).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gauss elimination of a small positive definite system."""
    a, b, n = a.copy(), b.copy(), len(b)
    for k in range(n):
        f = a[k + 1 :, k] / a[k, k]
        a[k + 1 :] -= f[:, None] * a[k]
        b[k + 1 :] -= f * b[k]
    for k in range(n - 1, -1, -1):
        b[k] = (b[k] - (a[k, k + 1 :] * b[k + 1 :]).sum()) / a[k, k]
    return b


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    ridge = np.full(x.shape[1], 1.0)
    ridge[0] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip((x * w).sum(axis=1), -30, 30)))
        g = (x * (weight * (p - y))[:, None]).sum(axis=0) + ridge * w
        r = weight * np.maximum(p * (1 - p), 1e-9)
        h = np.stack([(x * (x[:, k] * r)[:, None]).sum(axis=0) for k in range(x.shape[1])]) + np.diag(ridge)
        step = _solve(h, g)
        w = w - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(rows: list[tuple[int, bytes, int]], shares: tuple[float, float]) -> Model:
    """Fit on (doc_id, text, label); shares: how many labelled rows one of the sample stands for, by label."""
    rows = sorted({(zlib.crc32(x), k, x, y) for k, x, y in rows})
    seen: set[bytes] = set()
    rows = [r for r in rows if not (r[2] in seen or seen.add(r[2]))]  # copies count once
    n = [sum(r[3] == y for r in rows) for y in (0, 1)]
    prior = (n[1] * shares[1] + 0.1) / (n[0] * shares[0] + n[1] * shares[1] + 1)
    own, rest = [r for r in rows if r[0] % 2], [r for r in rows if not r[0] % 2]
    none = np.zeros(0)
    if min(n) < FEWEST:
        return Model(b"", b"", none, none, none, prior)
    ordinary, toxic = _dictionaries(*([r[2] for r in own if r[3] == y] for y in (0, 1)))
    model = Model(toxic, ordinary, none, none, none, prior)
    f = model.features(*_prepared([r[2] for r in rest]), model.compressors())
    y = np.array([r[3] for r in rest], dtype=float)
    model.center, model.scale = f.mean(axis=0), f.std(axis=0) + 1e-9
    weight = np.where(y > 0, shares[1], shares[0])
    model.weights = _logistic((f - model.center) / model.scale, y, weight / weight.mean())
    return model


def crc_mod(column: str, mod: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(mod))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the labelled documents that are not held out.

    Where a document has several labels it is toxic if one of them says so; null labels and
    ids do not count, nor do labels without a document. Of rows that share an id, the text
    with the least hash is the one that counts.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(crc_mod("doc_id", FOLDS) != HELD_OUT)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null and length(text) > 0")
    told = F.struct(F.xxhash64("text").alias("name"), F.octet_length("text").alias("size"))
    # Ids, lengths and hashes only: texts of the chosen rows are fetched by a second pass.
    there = written(texts.select("doc_id", told.alias("told")).groupBy("doc_id").agg(F.min("told").alias("told")).join(known, "doc_id").select("doc_id", "toxic", "told.name", "told.size"))
    counts = {r["toxic"]: r["n"] for r in there.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    chosen: dict[int, tuple[int, int]] = {}
    for y in (0, 1):
        left = SAMPLE_BYTES
        own = there.where((F.col("toxic") == y) & (F.col("size") <= ROW_BYTES)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        for r in own.select("doc_id", "name", "size").collect():  # sample_rows at most
            if r["size"] <= left:
                left -= r["size"]
                chosen[r["doc_id"]] = (r["name"], y)
    if not chosen:
        return train([], (1.0, 1.0))
    ids = docs.sparkSession.createDataFrame([(k, name) for k, (name, _) in chosen.items()], "doc_id long, name long")  # at most 2 * sample_rows ids
    found = texts.join(F.broadcast(ids), "doc_id").where(F.xxhash64("text") == F.col("name")).select("doc_id", "text")
    # Copies under one id are alike, but for texts of equal hashes: the greatest of them.
    held = dict(sorted((r["doc_id"], r["text"].encode()) for r in found.distinct().collect()))
    rows = [(k, x, chosen[k][1]) for k, x in held.items()]
    got = [max(1, sum(r[2] == y for r in rows)) for y in (0, 1)]
    model = train(rows, (counts.get(0, 0) / got[0], counts.get(1, 0) / got[1]))
    T.trim()
    return model


def _scored(sent, names: list[str]):
    """The rows of batches with their scores; sent: the broadcast model. Beside a batch, one slice is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = sent.value.compressors() if len(sent.value.weights) else []
        for b in batches:
            texts = b.column("text").cast(pa.string())
            data, offs = T.buffers(texts)
            for x, y in T.slices(offs):
                low, bounds = T.of_range(data, offs, x, y)
                low = T.LOWER[low]
                low[~T.SPACED[low]] = 0x20
                got = sent.value.scores(low, bounds, tools)
                own = b.slice(x, y - x)
                yield pa.record_batch([*own.columns, pa.array(got, pa.float64())], names=names)
            T.trim()

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, with SCORE (0 to 1) behind them; every window of each text counts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of half a megabyte at most
    schema = docs.drop(SCORE).withColumn(SCORE, F.lit(0.0)).schema
    return docs.drop(SCORE).mapInArrow(_scored(sent, schema.names), schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Score every document: doc_id, held_out, score, predicted.

    docs: doc_id long, text string; labels: doc_id long, toxic 0/1. Null and empty texts get
    the score of a text without windows; with fewer than FEWEST labelled texts of either label
    all get the share of toxic ones, 0.1 without labels. Rows with a null doc_id go; repeated rows are scored each.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    out = score(picked, fit(docs, labels, sample_rows))
    return out.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= THRESHOLD).cast("int").alias("predicted"))
