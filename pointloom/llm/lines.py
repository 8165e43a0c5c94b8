"""Line dedup by winnowing over line hashes.

The fingerprint of a window of ``run`` lines is the least hash of its grams of ``gram``
lines, the first of them where several are equal; so each window has one, and equal windows
have the same at the same place inside. The chunks ask which fingerprints stand at two
places; the windows of the others cannot repeat. Where repeats also qualify by their words,
windows of fewer lines that hold that many take part like the others.

The fingerprints left are joined by position: each goes to its bucket with its place and the
names of the lines around it, as far as a window can reach. There the matches are extended
line by line to both sides, and of equal windows around equal fingerprints the earliest
place is found. What later windows cover together are the repeated runs, which are deleted
but for their first occurrence. A chunk sends equal surroundings once, with their earliest
place. Of equal texts only the first is asked about; the others go whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import text as T
from .substring import _answer_symbols, _distinct, _one_or_many, _roots, _window_keys, covered
from .text import U64

_ROOT = U64((1 << 48) - 1)
#: Lines, or words, of a repeated run that is deleted.
RUN, WORDS = 3, 50
RESULT = "doc_id long, n_lines long, n_removed long, text string"


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of lines, empty ones too, and the line range of each document."""
    breaks = np.flatnonzero(data == 10)
    live = np.diff(offs) > 0
    doc = np.searchsorted(offs, breaks, side="right") - 1
    counts = np.bincount(doc, minlength=len(offs) - 1) + live
    starts = np.sort(np.concatenate([offs[:-1][live], breaks + 1]))
    at = np.concatenate([[0], np.cumsum(counts)])
    # A line ends at its break or at its document's end.
    ends = np.sort(np.concatenate([offs[1:][live], breaks]))
    return starts, ends, at


def _lines(body: bytes):
    """Documents' ids, bytes and offsets; both names of their lines, words in them, and their ranges of lines."""
    ids, data, offs = B.unpack_chunk(body)
    found, others, counts, words = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
    for a, z in T.slices(offs):
        own, bounds = T.of_range(data, offs, a, z)
        s, e, at = spans(own, bounds)
        for to, x in zip((found, others), T.names(own, s, e), strict=True):
            to.append(x)
        counts.append(np.diff(at))
        # A word begins at a byte of a word that follows none; a line's first byte follows a break.
        word = T.SPACED[own]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        begins[bounds[:-1][np.diff(bounds) > 0]] = word[bounds[:-1][np.diff(bounds) > 0]]
        sums = np.concatenate([[0], np.cumsum(begins)])
        words.append(sums[e] - sums[s])
    return ids, data, offs, np.concatenate(found), np.concatenate(others), np.concatenate(words), np.cumsum(np.concatenate(counts))


def _fingerprints(lines: np.ndarray, at: np.ndarray, run: int, gram: int):
    """First line, document, fingerprint and its first line, of each window of ``run`` lines."""
    n = np.diff(at)
    many = np.maximum(n - run + 1, 0)
    where = np.repeat(at[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    doc = np.repeat(np.arange(len(n)), many)
    if not len(where):
        return where, doc, np.zeros(0, U64), where
    grams = T.chained(lines, np.arange(len(lines) - gram + 1), gram, 61)
    spot = where + sliding_window_view(grams, run - gram + 1).argmin(axis=1)[where]
    return where, doc, grams[spot], spot


def _windows(lines: np.ndarray, counts: np.ndarray, at: np.ndarray, run: int, gram: int, words: int | None):
    """First line, lines, document, fingerprint and its line of the windows of ``run`` lines and of fewer with ``words`` words."""
    found = []
    sums = np.concatenate([[0], np.cumsum(counts)])
    for many in range(run if words is None else 1, run + 1):
        where, *more = _fingerprints(lines, at, many, min(gram, many))
        if many < run:
            enough = sums[where + many] - sums[where] >= words
            where, more = where[enough], [x[enough] for x in more]
        found.append((where, np.full(len(where), many), *more))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _ask_prints(n_buckets: int, run: int, gram: int, words: int | None):
    def go(chunk: int, body: bytes) -> pa.RecordBatch:
        ids, _, _, lines, others, counts, at = _lines(body)
        roots, rest = _roots(lines, others, at)
        where, many_lines, doc, prints, _ = _windows(lines, counts, at, run, gram, words)
        # Windows of one text share a fingerprint where they overlap; what counts is a second
        # text, or a window of equal lines at another place of the same text.
        keys, owner, many = _one_or_many(prints, (roots & _ROOT)[doc], np.zeros(len(prints), bool))
        high, low = _window_keys(lines, others, where, many_lines)
        order = np.lexsort((low, high, doc))
        again = np.flatnonzero((doc[order][1:] == doc[order][:-1]) & (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1]))
        many[np.searchsorted(keys, prints[order[again]])] = True
        cut = B.split(keys, n_buckets)
        own, rest, least, _ = _distinct(roots, rest, ids)
        top = B.split(own, n_buckets)
        return B.rows([(chunk, "prints", b, B.dump(sorted_keys=keys[i:j], owner=np.where(many[i:j], U64(0), owner[i:j]), many=many[i:j], sorted_roots=own[k:m], rest=rest[k:m], least=least[k:m])) for b, (i, j, k, m) in enumerate(zip(cut, cut[1:], top, top[1:], strict=False)) if j > i or m > k])

    return go


def _first_place(high, low, doc_id, line):
    """Distinct (high, low) in order, the earliest (doc_id, line) of each, and each row's place among them."""
    order = np.lexsort((line, doc_id, low, high))
    h, lo = high[order], low[order]
    new = np.append(True, (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    place = np.empty(len(h), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return h[at], lo[at], doc_id[order][at], line[order][at], place


class _Spots:
    """Fingerprints of windows of ``many`` lines, with the lines around them that windows can reach.

    before: lines that a window can have before its fingerprint. asked: by fingerprint, and
    by how many lines before it a window begins, whether there is such a window.
    """

    def __init__(self, where, spot, ids, doc, at, lines, others, many: int, gram: int):
        gram = min(gram, many)
        self.before = many - gram
        self.spot, self.of = np.unique(spot, return_inverse=True)
        self.back = spot - where
        self.asked = np.zeros((len(self.spot), self.before + 1), dtype=bool)
        self.asked[self.of, self.back] = True
        own = np.zeros(len(self.spot), np.int64)
        own[self.of] = doc
        around = self.spot[:, None] + np.arange(-self.before, gram + self.before)
        inside = (around >= at[own][:, None]) & (around < at[own + 1][:, None])
        around = np.clip(around, 0, max(len(lines) - 1, 0))
        self.names = [np.where(inside, x[around], U64(0)) if len(lines) else np.zeros(around.shape, U64) for x in (lines, others)]
        self.doc, self.line = ids[own], self.spot - at[own]
        self.key = T.chained(lines, self.spot, gram, 61)
        # Equal surroundings are sent once, with their earliest place; in order of fingerprints.
        high, low = (_row_hash(np.concatenate([x, self.asked.astype(U64)], axis=1), 65 + k) for k, x in enumerate(self.names))
        high, _, self.first_doc, self.first_line, self.place = _first_place(high, low, self.doc, self.line)
        one = np.zeros(len(high), np.int64)
        one[self.place] = np.arange(len(self.spot))
        self.order = np.argsort(self.key[one], kind="stable")
        self.one = one[self.order]

    def block(self, i: int, j: int, many: int) -> dict[str, np.ndarray]:
        own = self.one[i:j]
        o = self.order[i:j]
        return {f"doc{many}": self.first_doc[o], f"line{many}": B.slim(self.first_line[o]), f"asked{many}": self.asked[own].reshape(-1), f"first{many}": self.names[0][own].reshape(-1), f"other{many}": self.names[1][own].reshape(-1)}

    def later(self, told: np.ndarray) -> np.ndarray:
        """Which windows, in the order given, stand at a later place; told: those of the sent ones that do."""
        sent = np.zeros((len(self.one), self.before + 1), dtype=bool)
        sent[self.order] = told.reshape(-1, self.before + 1)
        behind = (self.doc != self.first_doc[self.place]) | (self.line != self.first_line[self.place])
        return sent[self.place[self.of], self.back] | behind[self.of]


def _row_hash(x: np.ndarray, seed: int) -> np.ndarray:
    h = np.full(len(x), seed, dtype=U64)
    for k in range(x.shape[1]):
        h = T.mix(h ^ x[:, k], seed + k)
    return h


def _first_place(high, low, doc_id, line):
    """Distinct (high, low) in order, the earliest (doc_id, line) of each, and each row's place among them."""
    order = np.lexsort((line, doc_id, low, high))
    h, lo = high[order], low[order]
    new = np.append(True, (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    place = np.empty(len(h), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return h[at], lo[at], doc_id[order][at], line[order][at], place


def _sizes(run: int, words: int | None) -> range:
    return range(run if words is None else 1, run + 1)


def _ask_spots(n_buckets: int, run: int, gram: int, words: int | None):
    def go(chunk: int, found: dict) -> pa.RecordBatch:
        ids, _, _, lines, others, counts, at = _lines(found["text"][-1])
        where, many, doc, prints, spot = _windows(lines, counts, at, run, gram, words)
        told = [B.load(body) for _, body in sorted(found.get("shared", {}).items())]
        shared = np.concatenate([x["shared"] for x in told]) if told else np.zeros(0, bool)
        least = np.concatenate([x["least"] for x in told]) if told else ids[:0]
        copy = least[_distinct(*_roots(lines, others, at), ids)[3]] < ids
        stay = shared[np.searchsorted(np.unique(prints), prints)] & ~copy[doc]
        where, many, doc, spot = where[stay], many[stay], doc[stay], spot[stay]
        blocks: list[dict] = [{} for _ in range(n_buckets)]
        for m in _sizes(run, words):
            own = many == m
            spots = _Spots(where[own], spot[own], ids, doc[own], at, lines, others, m, gram)
            cut = B.split(spots.key[spots.one], n_buckets)
            for b, (i, j) in enumerate(zip(cut, cut[1:], strict=False)):
                if j > i:
                    blocks[b] |= spots.block(i, j, m)
        state = (chunk, "state", chunk % n_buckets, B.dump(where=where, lines=B.slim(many), spot=spot, copy=copy))
        return B.rows([state] + [(chunk, "spots", b, B.dump(**x)) for b, x in enumerate(blocks) if x])

    return go


def _answer_spots(run: int, gram: int, words: int | None):
    def go(table: pa.Table) -> pa.RecordBatch:
        out, asked, who = [], [], []
        for c, kind, b, body in zip(*(table[x].to_pylist() for x in ("chunk", "kind", "bucket", "body")), strict=True):
            if kind == "state":
                out.append((c, kind, b, body))
            else:
                asked.append(B.load(body))
                who.append((c, b))
        answers: list[dict] = [{} for _ in asked]
        for m in _sizes(run, words):
            have = [k for k, x in enumerate(asked) if f"doc{m}" in x]
            if not have:
                continue
            before = m - min(gram, m)
            doc, line, wanted, first, other = (np.concatenate([asked[k][f"{x}{m}"] for k in have]) for x in ("doc", "line", "asked", "first", "other"))
            line, wanted = line.astype(np.int64), wanted.reshape(len(doc), -1)
            names = first.reshape(len(doc), -1), other.reshape(len(doc), -1)
            later = np.zeros(wanted.shape, dtype=bool)
            # A window begins ``back`` lines before its fingerprint and goes on to its other side.
            for back in range(before + 1):
                own = np.flatnonzero(wanted[:, back])
                keys = (_row_hash(x[own, before - back : before - back + m], 67 + k) for k, x in enumerate(names))
                _, _, first_doc, first_line, place = _first_place(*keys, doc[own], line[own] - back)
                later[own, back] = (first_doc[place] != doc[own]) | (first_line[place] != line[own] - back)
            at = 0
            for k in have:
                n = len(asked[k][f"doc{m}"])
                answers[k][f"later{m}"] = later[at : at + n].reshape(-1)
                at += n
        return B.rows(out + [(c, "later", b, B.dump(**x)) for (c, b), x in zip(who, answers, strict=True)])

    return go


def _rewrite(run: int, gram: int, words: int | None, finish):
    def go(chunk: int, found: dict) -> pa.RecordBatch:
        body = found["text"][-1]
        ids, data, offs, lines, others, counts, at = _lines(body)
        (state,) = (B.load(x) for x in found["state"].values())
        where, many, spot, copy = state["where"], state["lines"].astype(np.int64), state["spot"], state["copy"]
        n = np.diff(at)
        doc = np.repeat(np.arange(len(ids)), n)
        told = [B.load(x) for _, x in sorted(found.get("later", {}).items())]
        later = np.zeros(len(where), dtype=bool)
        for m in _sizes(run, words):
            own = many == m
            spots = _Spots(where[own], spot[own], ids, doc[where[own]], at, lines, others, m, gram)
            later[own] = spots.later(np.concatenate([np.zeros(0, bool), *[x[f"later{m}"] for x in told if f"later{m}" in x]]))
        whole = n >= run
        if words is not None:
            whole |= (n > 0) & (np.bincount(doc, weights=counts, minlength=len(ids)) >= words)
        gone = covered(where[later], many[later], len(lines)) | (copy & whole)[doc]
        removed = np.bincount(doc[gone], minlength=len(ids)).astype(np.int64)
        texts = []
        for a, z in T.slices(offs):
            raw, bounds = T.of_range(data, offs, a, z)
            s, e, _ = spans(raw, bounds)
            raw = raw.tobytes()
            for d in range(a, z):
                if not removed[d]:
                    texts.append(raw[bounds[d - a] : bounds[d - a + 1]])
                else:
                    stay = np.flatnonzero(~gone[at[d] : at[d + 1]]) + (at[d] - at[a])
                    texts.append(b"\n".join([raw[x:y] for x, y in zip(s[stay].tolist(), e[stay].tolist(), strict=True)]))
        return finish(body, ids, n, removed, pa.array(texts, pa.binary()).cast(pa.string()))

    return go


def _dedup(docs: DataFrame, run: int, gram: int, words: int | None, finish, schema, extra: bool) -> DataFrame:
    if not 1 <= gram <= run or words is not None and words < 1:
        raise ValueError("1 <= gram <= run and 1 <= words must hold")
    parts = B.chunks(docs, extra=extra)
    n = B.buckets(parts)
    shared = B.by_bucket(B.by_row(parts, _ask_prints(n, run, gram, words)), _answer_symbols)
    asked = B.by_chunk([parts, shared], _ask_spots(n, run, gram, words))
    told = B.by_bucket(asked, _answer_spots(run, gram, words))
    return B.by_chunk([parts, told], _rewrite(run, gram, words, finish), schema)


def line_dedup(docs: DataFrame, run: int | None = None, gram: int = 2, words: int | None = None) -> DataFrame:
    """Delete the lines covered by a run of ``run`` lines that also begins at an earlier place.

    With ``words``, a run of fewer lines that together hold that many words counts as well:
    then no run of whole lines with ``run`` lines or ``words`` words is left at a second
    place of the input. A passage that is only part of a line is not looked for. With neither
    run nor words given both hold, at RUN and WORDS; with run alone, lines alone count, as in
    the query's SQL. Words are ``[^\\x20\\x09-\\x0D]+``.

    docs: doc_id long, text string; other columns are not read. Lines end at line feeds; an
    empty line is a line; null and empty texts have none. Places are ordered by doc_id, then
    by line number; rows that share a doc_id and hold the same lines are at equal places,
    so neither is later. Runs are judged on the input. Returns per document doc_id, n_lines,
    n_removed and text (the lines that stay, joined by line feeds; empty if none). Rows with
    a null doc_id go; a document of fewer lines than the run, and fewer words than ``words``
    where that is given, stays whole.
    """
    if run is None:
        run, words = RUN, WORDS if words is None else words

    def finish(_, ids, n, removed, text) -> pa.RecordBatch:
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed), text], names=["doc_id", "n_lines", "n_removed", "text"])

    return _dedup(docs, run, gram, words, finish, RESULT, extra=False)


def deduped(docs: DataFrame, run: int = RUN, gram: int = 2, words: int | None = None) -> DataFrame:
    """The rows of docs, all columns, with later repeated runs deleted from text.

    Runs are those of line_dedup; by words too only if ``words`` is given.
    n_chars, where there is such a column, follows the new text. Documents that lose all
    their lines go; rows with a null doc_id go, since they have no place.
    """
    names = docs.columns

    def finish(body, ids, n, removed, text) -> pa.RecordBatch:
        kept = pa.array(~((removed == n) & (n > 0)))
        more = B.unpack_extra(body)
        return pa.record_batch([text if k == "text" else more.column(k) for k in names], names=names).filter(kept)

    out = _dedup(docs, run, gram, words, finish, docs.schema, extra=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
