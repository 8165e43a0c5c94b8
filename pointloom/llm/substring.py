"""Substring dedup by recompression.

Each document is parsed by rounds that name runs and pairs (recompress.py); equal
substrings get the same symbols but near their ends. The chunks ask which symbols stand in
two different texts. A window of words can only be a repeat if all symbols that it
determines do, so few windows are left; these are compared by two 64-bit names made of two
independent names of each word, and for each the smallest document that holds it is found. The whole document is
the topmost symbol: of equal texts only the one with the smallest id is parsed further,
and the others go whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from . import text as T
from .recompress import open_windows, parse
from .text import U64

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
_ROOT = U64((1 << 48) - 1)


def _words(body: bytes):
    """Documents' ids, bytes and offsets, both names of their words, and their ranges of words."""
    ids, data, offs = B.unpack_chunk(body)
    return ids, data, offs, *T.all_names(data, offs)


def _roots(tokens: np.ndarray, others: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two names of each document's sequence of words or lines."""
    return T.segment_hash(tokens, at[:-1], at[1:]), T.segment_hash(others, at[:-1], at[1:], 1)


def _symbols(tokens: np.ndarray, at: np.ndarray, rounds: int, window: int):
    """Names, spans and document of the symbols that some window determines."""
    name, left, right, doc = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    n = len(at) - 1
    step = 0
    while step < n:
        to = min(max(int(np.searchsorted(at, at[step] + 200_000, side="right")) - 1, step + 1), n)
        own = at[step : to + 1] - at[step]
        k, l, r = parse(tokens[at[step] : at[to]], own, rounds)
        d = np.searchsorted(own, (l + r) // 2, side="right") - 1
        d = np.clip(d, 0, to - step - 1)
        ok = (r - l <= window) & (l >= own[d]) & (r <= own[d + 1])
        name.append(k[ok])
        left.append(l[ok] + at[step])
        right.append(r[ok] + at[step])
        doc.append(d[ok] + step)
        step = to
    return [np.concatenate(x) for x in (name, left, right, doc)]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of sorted keys, and the keys."""
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return at, keys[at]


def _one_or_many(keys: np.ndarray, owner: np.ndarray, many: np.ndarray):
    """For each distinct key: an owner, and whether it has several."""
    order = np.argsort(keys, kind="stable")
    keys, owner, many = keys[order], owner[order], many[order]
    at, found = _groups(keys)
    if not len(at):
        return found, owner, many
    low, high = np.minimum.reduceat(owner, at), np.maximum.reduceat(owner, at)
    return found, low, (low != high) | np.logical_or.reduceat(many, at)


def _ask_symbols(n_buckets: int, rounds: int, window: int):
    def run(chunk: int, body: bytes) -> pa.RecordBatch:
        ids, _, _, tokens, others, at = _words(body)
        roots, rest = _roots(tokens, others, at)
        name, _, _, doc = _symbols(tokens, at, rounds, window)
        keys, owner, many = _one_or_many(name, (roots & _ROOT)[doc], np.zeros(len(name), bool))
        cut = B.split(keys, n_buckets)
        own, rest, least, _ = _distinct(roots, rest, ids)
        top = B.split(own, n_buckets)
        return B.rows([(chunk, "symbols", b, B.dump(sorted_keys=keys[i:j], owner=np.where(many[i:j], U64(0), owner[i:j]), many=many[i:j], sorted_roots=own[k:m], rest=rest[k:m], least=least[k:m])) for b, (i, j, k, m) in enumerate(zip(cut, cut[1:], top, top[1:], strict=False)) if j > i or m > k])

    return run


def _answer_symbols(table: pa.Table) -> pa.RecordBatch:
    asked = [B.load(x) for x in table["body"].to_pylist()]
    # Of keys with many owners the owner is unknown and must not count as another one.
    keys = np.concatenate([x["sorted_keys"] for x in asked])
    owner = np.concatenate([x["owner"] for x in asked])
    many = np.concatenate([x["many"] for x in asked])
    found, _, several = _one_or_many(keys, owner, many)
    _, _, least, place = _distinct(*(np.concatenate([x[k] for x in asked]) for k in ("sorted_roots", "rest", "least")))
    out, at = [], 0
    for c, b, x in zip(table["chunk"].to_pylist(), table["bucket"].to_pylist(), asked, strict=True):
        n = len(x["least"])
        out.append((c, "shared", b, B.dump(shared=several[np.searchsorted(found, x["sorted_keys"])], least=least[place[at : at + n]])))
        at += n
    return B.rows(out)


def _window_keys(tokens: np.ndarray, others: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two names of the windows that begin at the given words, each from other names of the words."""
    return T.segment_hash(tokens, at, at + window), T.segment_hash(others, at, at + window, 1)


def _distinct(high: np.ndarray, low: np.ndarray, value: np.ndarray):
    """Distinct (high, low) in order, the least value of each, and each row's place among them."""
    order = np.lexsort((low, high))
    high, low, value = high[order], low[order], value[order]
    new = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])) if len(high) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    place = np.empty(len(high), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return high[at], low[at], (np.minimum.reduceat(value, at) if len(at) else value), place


def _ask_windows(n_buckets: int, rounds: int, window: int):
    def run(chunk: int, found: dict) -> pa.RecordBatch:
        ids, _, _, tokens, others, at = _words(found["text"][-1])
        name, left, right, _ = _symbols(tokens, at, rounds, window)
        told = [B.load(body) for _, body in sorted(found.get("shared", {}).items())]
        shared = np.concatenate([x["shared"] for x in told]) if told else np.zeros(0, bool)
        least = np.concatenate([x["least"] for x in told]) if told else ids[:0]
        copy = least[_distinct(*_roots(tokens, others, at), ids)[3]] < ids
        keys = np.unique(name)
        free = open_windows(left, right, ~shared[np.searchsorted(keys, name)], at, window)
        doc = np.repeat(np.arange(len(ids)), np.diff(at))
        # Of equal texts in one chunk only one has the least id; rows that share an id stay.
        where = np.flatnonzero(free & ~copy[doc])
        high, low = _window_keys(tokens, others, where, window)
        high, low, first, _ = _distinct(high, low, ids[doc[where]])
        cut = B.split(high, n_buckets)
        state = (chunk, "state", chunk % n_buckets, B.dump(sorted_where=where, copy=copy))
        return B.rows([state] + [(chunk, "windows", b, B.dump(sorted_keys=high[i:j], low=low[i:j], least=first[i:j])) for b, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if j > i])

    return run


def _answer_windows(table: pa.Table) -> pa.RecordBatch:
    out, asked, who = [], [], []
    for c, kind, b, body in zip(*(table[x].to_pylist() for x in ("chunk", "kind", "bucket", "body")), strict=True):
        if kind == "state":
            out.append((c, kind, b, body))
        else:
            asked.append(B.load(body))
            who.append((c, b))
    if asked:
        high, low, least = (np.concatenate([x[k] for x in asked]) for k in ("sorted_keys", "low", "least"))
        _, _, least, place = _distinct(high, low, least)
        at = 0
        for (c, b), x in zip(who, asked, strict=True):
            n = len(x["low"])
            out.append((c, "least", b, B.dump(least=least[place[at : at + n]])))
            at += n
    return B.rows(out)


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Words that lie in a window beginning at one of starts."""
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + window, n), -1)
    return np.cumsum(marks)[:n] > 0


def joined(data: np.ndarray, offs: np.ndarray, stay: np.ndarray) -> list[memoryview]:
    """Each document's staying words, joined by one space."""
    starts, ends, at = T.spans(data, offs, T.SPACED)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))[stay]
    starts, ends = starts[stay], ends[stay]
    more = np.append(doc[1:] == doc[:-1], False) if len(doc) else np.zeros(0, bool)
    data = data.copy()
    data[ends[more]] = 0x20
    marks = np.zeros(len(data) + 2, dtype=np.int8)
    marks[starts] += 1
    marks[ends + more] -= 1
    picked = data[np.cumsum(marks, dtype=np.int8)[: len(data)] > 0].tobytes()
    to = np.cumsum(np.bincount(doc, weights=ends + more - starts, minlength=len(offs) - 1)).astype(np.int64).tolist()
    view = memoryview(picked)
    return [view[x:y] for x, y in zip([0, *to[:-1]], to, strict=True)]


def _rewrite(window: int, texts: bool):
    def run(chunk: int, found: dict) -> pa.RecordBatch:
        ids, data, offs, tokens, others, at = _words(found["text"][-1])
        (state,) = (B.load(x) for x in found["state"].values())
        where, copy = state["sorted_where"], state["copy"]
        doc = np.repeat(np.arange(len(ids)), np.diff(at))
        high, low = _window_keys(tokens, others, where, window)
        told = [B.load(body)["least"] for _, body in sorted(found.get("least", {}).items())]
        least = np.concatenate(told) if told else ids[:0]
        _, _, _, place = _distinct(high, low, ids[doc[where]])
        hit = where[least[place] < ids[doc[where]]]
        gone = covered(hit, window, len(tokens)) | (copy & (np.diff(at) >= window))[doc]
        kept, digest = [], []
        removed = np.bincount(doc[gone], minlength=len(ids)).astype(np.int64)
        for a, z in T.slices(offs):
            for text in joined(*T.of_range(data, offs, a, z), ~gone[at[a] : at[z]]):
                digest.append(hashlib.sha256(text).hexdigest())
                kept.append(str(text, "utf-8") if texts else None)
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(removed), pa.array(digest, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def substring_dedup(docs: DataFrame, window: int = 50, rounds: int = 5, texts: bool = True) -> DataFrame:
    """Remove the words covered by a window of words that also begins in a smaller document.

    docs: doc_id long, text string; other columns are not read. Returns per document doc_id,
    n_words, n_removed, kept_sha256 (of the kept words joined by one space) and, if texts,
    kept (that string; else null). Null and empty texts have no words; rows with a null
    doc_id go; rows that share a doc_id are judged each for itself, never against each
    other; a document shorter than the window stays whole. Windows are judged on the input.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    parts = B.chunks(docs)
    n = B.buckets(parts)
    shared = B.by_bucket(B.by_row(parts, _ask_symbols(n, rounds, window)), _answer_symbols)
    asked = B.by_chunk([parts, shared], _ask_windows(n, rounds, window))
    told = B.by_bucket(asked, _answer_windows)
    return B.by_chunk([parts, told], _rewrite(window, texts), RESULT)
