"""N-gram Jaccard join by parity sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.lineage import written
from . import blocks as B
from . import text as T
from .text import U64


def shingles(tokens: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and each document's bounds in them.

    A document with fewer words than the size has one shingle, of all its words; one
    without words has none.
    """
    n = np.diff(at)
    many = np.maximum(n - size + 1, (n > 0).astype(n.dtype))
    starts = np.repeat(at[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    ends = np.minimum(starts + size, np.repeat(at[1:], many))
    h = T.mix(ends - starts, 41)
    for k in range(size):
        live = slice(None) if not k or (n[n > 0] >= size).all() else np.flatnonzero(starts + k < ends)
        h[live] = T.mix(h[live] ^ tokens[starts[live] + k], 42 + k)
    doc = np.repeat(np.arange(len(n)), many)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def bands(most: int, ratio: float = 1.5) -> np.ndarray:
    """Upper sizes of the size bands, until ``most``."""
    out, u = [], 1
    while True:
        out.append(u)
        if u >= most:
            return np.array(out, dtype=np.int64)
        u = max(u + 1, int(u * ratio))


def budget(upper, percent: int):
    """The largest symmetric difference of linked sets, the smaller of at most ``upper``.

    With union u and intersection i, i >= p u and |A| + |B| = u + i, so u - i is at most
    (1 - p) / p times i, and i is at most the smaller size.
    """
    return upper * (100 - percent) // percent


#: Parts of a sketch beyond what the pigeonhole asks for.
SPARE = 2


def signatures(h: np.ndarray, bounds: np.ndarray, percent: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, document) of the sketch parts by which the chosen linked documents must meet.

    Configuration k is for pairs whose smaller set is in band k. A sketch of it has SPARE + 1
    parts more than the symmetric difference that such a pair can have. A part is a wide bit
    string in which each of its shingles flips one bit, and is named by the XOR of the names
    of the bits that are set. An element of the symmetric difference changes at most one
    part, so linked documents agree in SPARE + 1 parts at least. Parts without shingles say
    little, and are sent only where a document has more than SPARE of them: if all parts
    that two linked documents agree in are empty, both have that many.
    """
    sizes = np.diff(bounds)
    if not len(sizes) or not sizes.max(initial=0):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    upper = bands(int(sizes.max()))
    own = np.searchsorted(upper, sizes)
    live = np.flatnonzero(chosen & (sizes > 0))
    doc, band = [live], [own[live]]
    # As the larger set of a pair a document belongs to lower bands too, while their sets can be 'percent' of its size.
    down, k = live, own[live] - 1
    while len(down):
        fits = (k >= 0) & (upper[np.maximum(k, 0)] * 100 >= sizes[down] * percent)
        down, k = down[fits], k[fits]
        doc.append(down)
        band.append(k)
        k = k - 1
    doc, band = np.concatenate(doc), np.concatenate(band)
    parts = budget(upper[band], percent) + 1 + SPARE
    base = np.cumsum(parts) - parts
    n = sizes[doc]
    where = np.repeat(bounds[doc], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    bit = h[where]
    spot = np.repeat(base, n) + (bit % np.repeat(parts, n).astype(U64)).astype(np.int64)
    order = np.argsort(spot)
    spot, bit = spot[order], T.mix(bit, 45)[order]
    at = np.flatnonzero(np.append(True, spot[1:] != spot[:-1]))
    named = np.bitwise_xor.reduceat(bit, at)
    spot = spot[at]
    row = np.searchsorted(base, spot, side="right") - 1
    # Empty parts of those that have many.
    filled = np.bincount(row, minlength=len(doc))
    sparse = np.flatnonzero(parts - filled > SPARE)
    if len(sparse):
        m = parts[sparse]
        all_spots = np.repeat(base[sparse], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        empty = all_spots[~np.isin(all_spots, spot)]
        spot = np.concatenate([spot, empty])
        named = np.concatenate([named, np.zeros(len(empty), U64)])
        row = np.searchsorted(base, spot, side="right") - 1
    place = (spot - base[row]).astype(U64) + (band[row].astype(U64) << U64(40))
    return T.mix(named ^ T.mix(place, 43), 44), doc[row]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def set_hashes(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each shingle set."""
    out = []
    n = np.diff(bounds).astype(U64)
    for seed in (51, 52):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(T.mix(h, seed), dtype=U64)])
        out.append(T.mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ T.mix(n, seed), seed + 2))
    return out[0], out[1]


def _gather(size: int, percent: int):
    """Rows of a batch of documents: one for each document, and all their sketch words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = T.buffers(b.column("text"))
            all_ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for a, z in T.slices(offs, B.CHUNK_BYTES):
                ids = all_ids[a:z]
                tokens, at = T.all_words(*T.of_range(data, offs, a, z), lower=True)
                h, bounds = shingles(tokens, at, size)
                high, low = set_hashes(h, bounds)
                n = np.diff(bounds)
                # Of equal sets in the batch the least document stands for all.
                order = np.lexsort((ids, low, high))
                new = ~np.append(np.zeros(min(1, len(ids)), bool), (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1]))
                rep, stands = np.zeros(len(ids), dtype=bool), np.empty(len(ids), np.int64)
                rep[order[new]] = True
                stands[order] = ids[order[new]][np.cumsum(new) - 1]
                yield _rows("doc", ids, n, _signed(high), _signed(low), [None] * len(ids), stands, rep)
                keys, doc = signatures(h, bounds, percent, rep)
                order = np.argsort(keys, kind="stable")
                yield _rows("keys", np.zeros(1, np.int64), None, None, None, [B.dump(sorted_keys=keys[order], doc=ids[doc[order]])])
                del tokens, h, keys, doc
                T.trim()

    return run


_GATHERED = "kind string, id long, n long, high long, low long, body binary, stands long, rep boolean"


def _rows(kind, ids, n, high, low, body, stands=None, rep=None) -> pa.RecordBatch:
    own = lambda x, t: pa.nulls(len(ids), t) if x is None else pa.array(x, t)
    numbers = [own(x, pa.int64()) for x in (n, high, low)]
    return pa.record_batch([pa.array([kind] * len(ids), pa.string()), pa.array(ids, pa.int64()), *numbers, pa.array(body, pa.binary()), own(stands, pa.int64()), own(rep, pa.bool_())], names=["kind", "id", "n", "high", "low", "body", "stands", "rep"])


def _by_bucket(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column("body"):
                x = B.load(body.as_py())
                cut = B.split(x["sorted_keys"], n_buckets)
                found = [(k, B.dump(sorted_keys=x["sorted_keys"][i:j], doc=x["doc"][i:j])) for k, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if j > i]
                yield pa.record_batch([pa.array([k for k, _ in found], pa.int64()), pa.array([v for _, v in found], pa.binary())], names=["bucket", "body"])

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Each document that shares sketch words, with the least documents that have them and with how many of them."""
    asked = [B.load(x) for x in table["body"].to_pylist()]
    keys, doc = (np.concatenate([x[k] for x in asked]) for k in ("sorted_keys", "doc"))
    order = np.lexsort((doc, keys))
    keys, doc = keys[order], doc[order]
    new = np.append(True, keys[1:] != keys[:-1])
    first = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    pairs, n = np.unique(np.stack([first, doc], axis=1)[first != doc], axis=0, return_counts=True)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64()), "n": pa.array(n, pa.int64())})


def _sets(size: int, names: list[str]):
    """The packed shingles of each text, with the named columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = T.buffers(b.column("text"))
            for a, z in T.slices(offs):
                tokens, at = T.all_words(*T.of_range(data, offs, a, z), lower=True)
                h, bounds = shingles(tokens, at, size)
                own = b.slice(a, z - a)
                body = pa.array([h[i:j].tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
                yield pa.record_batch([*[own.column(k) for k in names], body], names=[*names, "body"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _star(percent: int):
    """Verified links of documents with the document that they are grouped by."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hub = key[0].as_py()
        ids, sets = table["doc_id"].to_pylist(), [np.frombuffer(x, U64) for x in table["body"].to_pylist()]
        own = next((x for k, x in zip(ids, sets, strict=True) if k == hub), None)
        found = [k for k, x in zip(ids, sets, strict=True) if own is not None and k != hub and _linked(own, x, percent)]
        return pa.table({"a": pa.array([hub] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return run


#: Documents of a cluster that a task compares at once, about.
BLOCK_DOCS = 400


def _link(percent: int):
    """Verified links that join what a block pair holds, by its own union-find."""

    def sketch(sets: list[np.ndarray], words: int) -> np.ndarray:
        out = np.zeros((len(sets), words), dtype=U64)
        for k, a in enumerate(sets):
            spot = (a % U64(words)).astype(np.int64) * 64 + ((a >> U64(50)) & U64(63)).astype(np.int64)
            out[k] = np.packbits((np.bincount(spot, minlength=words * 64) & 1).astype(np.uint8)).view(U64)
        return out

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        ids, block, group = table["doc_id"].to_numpy(), table["block"].to_numpy(), table["group"].to_numpy()
        sets = [np.frombuffer(x, U64) for x in table["body"].to_pylist()]
        sizes = np.array([len(x) for x in sets])
        order = np.lexsort((ids, sizes))
        ids, block, group, sizes, sets = ids[order], block[order], group[order], sizes[order], [sets[k] for k in order]
        # What is already linked is one to begin with, and needs no comparison.
        root = np.unique(group, return_index=True, return_inverse=True)[1:]
        root = root[0][root[1]].tolist()

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = []
        at = 0
        while at < len(ids):
            # Documents at of like sizes share a sketch with all larger ones that could link with them.
            to = max(at + 1, int(np.searchsorted(sizes, sizes[at] * 1.1, side="right")))
            to = min(to, at + 64)
            end = int(np.searchsorted(sizes * percent, sizes[to - 1] * 100, side="right"))
            own = sketch(sets[at:end], budget(int(sizes[to - 1]), percent) + 1)
            for x in range(at, to):
                other = np.arange(x + 1, end)
                other = other[(sizes[other] * percent <= sizes[x] * 100) & (group[other] != group[x]) & ((block[other] != block[x]) if i != j else True)]
                if not len(other):
                    continue
                apart = np.bitwise_count(own[other - at] ^ own[x - at]).sum(axis=1, dtype=np.int64)
                for y in other[apart * (100 + percent) <= (100 - percent) * (sizes[x] + sizes[other])].tolist():
                    if find(x) != find(y):
                        if _linked(sets[x], sets[y], percent):
                            root[find(x)] = find(y)
                            found.append((int(ids[x]), int(ids[y])))
            at = to
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def jaccard_join(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """Link documents whose sets of word shingles have a Jaccard similarity of percent/100 or more.

    docs: doc_id long, text string; other columns are not read. Words are ``[^\\x20\\x09-\\x0D]+``
    with A-Z lower-cased. Returns per document doc_id, n_shingles and component_id, the least
    doc_id that links reach. Null and empty texts have an empty set and link with nothing;
    rows that share a doc_id are one vertex of the link graph; rows with a null doc_id go.

    Equal sets are found by 128-bit names; one document of each stands for them. The others
    meet by sketch words (see ``signatures``), never as pairs of a group but as a star around
    its least document. Each document is first verified against the one of these that it
    shares most words with. Groups of links that this leaves, where sketch words connect
    them, are clusters within which further links can be. A cluster is cut into blocks, those
    of large groups apart; pairs of blocks that are not of one group compare sketches, verify
    what the Hamming distance allows by the sets themselves, and return a spanning forest of
    the links. So many copies of one text cost as many comparisons as there are copies.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    gathered = written(picked.mapInArrow(_gather(size, percent), _GATHERED))
    n = B.buckets(gathered)
    each = gathered.where("kind = 'doc'").select(F.col("id").alias("doc_id"), "n", "stands", "high", "low", "rep")
    # One row of each batch and set: a group of copies has no more of them than there are batches.
    reps = each.where("rep and n > 0").select("doc_id", "high", "low")
    least = reps.groupBy("high", "low").agg(F.min("doc_id").alias("rep"))
    copies = written(reps.join(least, ["high", "low"]).where("doc_id <> rep").select("doc_id", "rep"))
    keys = gathered.where("kind = 'keys'").select("body").mapInArrow(_by_bucket(n), "bucket long, body binary")
    met = keys.groupBy("bucket").applyInArrow(_meet, "a long, b long, n long")
    for side in ("a", "b"):
        met = met.join(copies.select(F.col("doc_id").alias(side), F.col("rep").alias(f"{side}_rep")), side, "left").withColumn(side, F.coalesce(f"{side}_rep", side)).drop(f"{side}_rep")
    met = written(met.where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n")))
    # A document and one that it may link with: linked ones share SPARE + 1 words at least.
    best = met.where(F.col("n") > SPARE).groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("hub"))
    parts = best.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("long").alias("parts"))
    whole = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    rays = best.join(parts, "hub").select(F.col("b").alias("doc_id"), "hub", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    rays = rays.unionByName(parts.select(F.col("hub").alias("doc_id"), "hub", whole.alias("part")))
    # One plan at every size: texts are dealt out by doc_id, whether or not the members would fit a broadcast.
    star = picked.join(rays.hint("merge"), "doc_id").mapInArrow(_sets(size, ["doc_id", "hub", "part"]), "doc_id long, hub long, part long, body binary")
    first = written(star.groupBy("hub", "part").applyInArrow(_star(percent), "a long, b long"))
    groups = connected_components(first)
    crossing = met.select("a", "b")
    for side in ("a", "b"):
        crossing = crossing.join(groups.select(F.col("id").alias(side), F.col("root").alias("root")), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    clusters = connected_components(crossing.where("a <> b").distinct())
    clusters = clusters.select(F.col("id").alias("group"), F.col("root").alias("cluster")).unionByName(clusters.select(F.col("root").alias("group"), F.col("root").alias("cluster")).distinct())
    members = clusters.join(groups.select(F.col("root").alias("group"), F.col("id").alias("doc_id")), "group").unionByName(clusters.select("group", "cluster", F.col("group").alias("doc_id")))
    # Blocks: large groups have their own, which are not compared among themselves.
    large = members.groupBy("cluster", "group").agg(F.count("*").alias("n")).where(F.col("n") >= BLOCK_DOCS).select("group", F.col("group").alias("own"))
    members = members.join(large, "group", "left")
    counts = members.groupBy("cluster", "own").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("long").alias("blocks"))
    placed = members.join(counts.withColumnRenamed("cluster", "c").withColumnRenamed("own", "o"), (F.col("cluster") == F.col("c")) & F.col("own").eqNullSafe(F.col("o"))).drop("c", "o")
    placed = written(placed.select("doc_id", "cluster", "group", "own", F.xxhash64(F.coalesce("own", F.lit(-1)), F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).alias("block")))
    blocks = placed.select("cluster", "own", "block").distinct()
    other = blocks.select("cluster", F.col("own").alias("other_own"), F.col("block").alias("other"))
    apart = F.col("own").isNull() | F.col("other_own").isNull() | (F.col("own") != F.col("other_own"))
    pairs = blocks.join(other, "cluster").where(apart).select("cluster", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    sets = picked.join(placed.hint("merge"), "doc_id").mapInArrow(_sets(size, ["doc_id", "cluster", "group", "block"]), "doc_id long, cluster long, group long, block long, body binary")
    links = sets.join(pairs, ["cluster", "block"]).groupBy("cluster", "i", "j").applyInArrow(_link(percent), "a long, b long")
    linked = first.unionByName(links).unionByName(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    joined = connected_components(linked)
    # A set stands for all documents of its batch that have it; empty ones stand for themselves.
    found = each.select("doc_id", "n", F.when(F.col("n") > 0, F.col("stands")).otherwise(F.col("doc_id")).alias("stands")).join(joined.withColumnRenamed("id", "stands"), "stands", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("root", "stands")).otherwise(F.col("doc_id")).alias("component_id"))
