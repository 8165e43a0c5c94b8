"""Language-model scores by Katz backoff.

P(w | h) is the discounted share d(c) c(h, w) / c(h) where the n-gram was seen in training,
else a(h) P(w | h'), where h' is h without its first word and the backoff weight a(h) makes
the probabilities of all words and of the unknown word sum to 1. P(w) is discounted in the
same way and leaves its rest to the unknown word. Discounts are Good and Turing's for small
counts, by order. Where they leave less than half a count, half a count is left.

Everything is counted over the whole training part. First the chunks of documents send the
bytes of their distinct words to buckets (blocks.py), which give each different word a
number of its own; the chunks are written again as numbers, so that n-grams are exact
tuples. Then, order by order, the chunks send their distinct n-grams to the buckets of their
histories. The buckets write the tables, partitioned by the chunks that need them: for each
n-gram its count, for each history its count and the numbers of its continuations by small
counts of their own and of the order below; these whole numbers give the weights in double
precision. An n-gram is sent only where its history and its lower order occur in training.
A history that no other chunk has is not sent: its chunk counts for itself. One with very
many occurrences is shared out over several buckets, whose numbers are added up. Scoring
reads a chunk with its parts of the tables and goes down the recursion for each token.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.lineage import discard, release, written
from . import blocks as B
from . import text as T
from .text import U64
from .tokens import distinct, gather

FOLDS, HELD_OUT, ORDER = 5, 1, 3
#: Counts up to SMALL are discounted.
SMALL = 5
#: Occurrences of a history for each bucket that it is shared out to.
SHARE = 1 << 20
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0..SMALL) from the numbers of types by count, n[0..SMALL + 1]; larger counts are not discounted.

    Good-Turing as Katz has it, with the largest limit k for which all discounts lie in
    (0, 1); where there is none, half a count goes off each count up to SMALL.
    """
    for k in range(SMALL, 0, -1):
        if not n[1 : k + 2].all():
            continue
        r = np.arange(1, k + 1)
        a = (k + 1) * n[k + 1] / n[1]
        d = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) if a != 1 else np.zeros(k)
        if ((d > 0) & (d < 1)).all():
            return np.concatenate([[0.0], d, np.ones(SMALL - k)])
    return np.concatenate([[0.0], 1 - 0.5 / np.arange(1, SMALL + 1)])


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c <= SMALL, d[np.minimum(c, SMALL)], 1.0) * c


class Unigrams:
    """P(w) by w's count; count 0 is the unknown word."""

    def __init__(self, stats: np.ndarray):
        self.n, self.types = int(stats[0]), int(stats[1])
        self.d = discounts(stats[2:])
        kept = self.n - ((1 - self.d[1:]) * np.arange(1, SMALL + 1) * stats[3 : 3 + SMALL]).sum()
        rest = max(self.n - kept, 0.5)  # at least half a count, as for histories
        self.unknown = rest / self.n if self.n else 1.0
        self.scale = (self.n - rest) / kept / self.n if self.n else 0.0

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) * self.scale, self.unknown)


def _small(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, SMALL + 2), minlength=SMALL + 3)[: SMALL + 2]


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 on in order, and where each stood, equal ones in their order.

    Numbers that carry their places below sort several times as fast as places do by numbers.
    """
    n, bits = len(key), len(key).bit_length()
    if not n or int(key.max()).bit_length() + bits > 63:
        by = np.argsort(key, kind="stable")
        return key[by], by
    packed = key << bits
    packed |= np.arange(n)
    packed.sort()
    by = packed & ((1 << bits) - 1)
    packed >>= bits
    return packed, by


def _new(ordered: np.ndarray) -> np.ndarray:
    new = np.ones(len(ordered), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return new


def _places(new: np.ndarray, by: np.ndarray) -> np.ndarray:
    """For each row, by an order and where its groups begin, the place of its group."""
    place = np.empty(len(by), np.int64)
    place[by] = np.cumsum(new) - 1
    return place


def _ranked(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of rows of whole numbers from 0 on, the first column first, and where rows differ from those before.

    Columns that fit in one number together are sorted at once, others in turn from the last.
    """
    room, turns, width = 63 - len(keys[0]).bit_length(), [], 64
    for key in reversed(keys):
        bits = int(key.max()).bit_length() if len(key) else 0
        if width + bits <= room:
            turns[-1] = turns[-1] | key << width
            width += bits
        else:
            turns.append(key)
            width = bits
    ordered, by = _sorted(turns[0])
    for key in turns[1:]:
        ordered, then = _sorted(key[by])
        by = by[then]
    new = _new(ordered)
    for key in turns[:-1]:
        new |= _new(key[by])
    return by, new


def _distinct(first: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``distinct``, by sorting the upper bits of the first names with their places, unless these bits or names stand for two strings."""
    bits = U64(len(first).bit_length())
    packed = first >> bits << bits
    packed |= np.arange(len(first), dtype=U64)
    packed.sort()
    by = (packed & ((U64(1) << bits) - U64(1))).astype(np.int64)
    ordered, names = first[by], other[by]
    new = _new(ordered)
    if (ordered[1:] < ordered[:-1]).any() or (~new[1:] & (names[1:] != names[:-1])).any():
        return distinct(first, other)
    return by[new], _places(new, by)


def _summed(counts: np.ndarray) -> np.ndarray:
    """Tokens, types, and types by count up to SMALL + 1."""
    return np.concatenate([[counts.sum(), (counts > 0).sum()], _small(counts)])


class _Chunk:
    """A chunk's documents, whether held out, and tokens: words with A-Z lower-cased and an end each."""

    def __init__(self, body: bytes):
        self.ids, data, offs = B.unpack_chunk(body)
        data = T.LOWER[data]
        starts, ends, first, other, counts = ([np.zeros(0, k)] for k in (np.int64, np.int64, U64, U64, np.int64))
        for a, z in T.slices(offs):
            w = T.words(*T.of_range(data, offs, a, z))
            for to, x in ((starts, w.starts + offs[a]), (ends, w.ends + offs[a]), (first, w.hashes), (other, w.others), (counts, w.counts())):
                to.append(x)
        starts, ends, first, other, counts = (np.concatenate(x) for x in (starts, ends, first, other, counts))
        at = np.concatenate([[0], np.cumsum(counts)])
        which, place = _distinct(first, other) if len(first) else (first.astype(np.int64), first.astype(np.int64))
        self.first, self.size = first[which], (ends - starts)[which]
        self.bytes = gather(data, starts[which], self.size)
        # The end is the chunk's last word.
        self.words = len(which) + 1
        self.tokens = np.insert(place, at[1:], len(which))
        self.at = at + np.arange(len(at))
        held = np.array([zlib.crc32(str(k).encode()) % FOLDS == HELD_OUT for k in self.ids.tolist()], dtype=bool)
        self.held, self.train = held, ~np.repeat(held, np.diff(self.at))


def _ask_words(n_buckets: int):
    def run(chunk: int, body: bytes) -> pa.RecordBatch:
        c = _Chunk(body)
        count = np.bincount(c.tokens[c.train], minlength=c.words).astype(np.int64)
        cut = B.split(c.first, n_buckets)
        to = np.concatenate([[0], np.cumsum(c.size)])
        blocks = [(chunk, "words", b, B.dump(text=c.bytes[to[i] : to[j]], size=B.slim(c.size[i:j]), count=B.slim(count[i:j]))) for b, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if j > i]
        return B.rows([*blocks, (chunk, "ends", chunk % n_buckets, B.dump(ends=count[-1:]))])

    return run


def _answer_words(n_buckets: int):
    """Numbers, frequent words first, and counts. 0 is the start, 1 the end; bucket b has b + 2 and every n_buckets-th from there."""

    def run(table: pa.Table) -> pa.RecordBatch:
        bucket = table["bucket"][0].as_py()
        loaded = [(c, kind, B.load(x)) for c, kind, x in zip(*(table[k].to_pylist() for k in ("chunk", "kind", "body")), strict=True)]
        ends = sum(int(x["ends"][0]) for _, kind, x in loaded if kind == "ends")
        asked = [(c, x) for c, kind, x in loaded if kind == "words"]
        out, total = [], np.zeros(0, np.int64)
        if asked:
            size = np.concatenate([x["size"].astype(np.int64) for _, x in asked])
            to = np.cumsum(size)
            at, place = _distinct(*T.names(np.concatenate([x["text"] for _, x in asked]), to - size, to))
            total = np.zeros(len(at), np.int64)
            np.add.at(total, place, np.concatenate([x["count"] for _, x in asked]))
            alone = np.bincount(place, minlength=len(at)) == 1
            number = np.empty(len(at), np.int64)
            number[np.argsort(-total, kind="stable")] = np.arange(len(at)) * n_buckets + bucket + 2
            begin = 0
            for c, x in asked:
                own = place[begin : begin + len(x["size"])]
                out.append((c, "counts", bucket, B.dump(number=B.slim(number[own]), count=B.slim(total[own]), alone=alone[own])))
                begin += len(own)
        return B.rows([*out, (-1, "stats", bucket, B.dump(stats=np.append(_summed(total), ends)))])

    return run


def _stats(table: DataFrame) -> np.ndarray:
    """Sums of the buckets' few numbers."""
    found = [B.load(r["body"])["stats"] for r in table.where("kind = 'stats'").select("body").toLocalIterator()]
    return np.sum(found, axis=0) if found else np.zeros(SMALL + 5, np.int64)


def _told(found: dict, kind: str, name: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[B.load(x)[name].astype(np.int64) for _, x in sorted(found.get(kind, {}).items())]])


def _encode(ends: int):
    """A chunk as numbers: its words in order of their numbers, with their counts, and the tokens by place among them."""

    def run(chunk: int, found: dict) -> pa.RecordBatch:
        c = _Chunk(found["text"][-1])
        number, count = np.append(_told(found, "counts", "number"), 1), np.append(_told(found, "counts", "count"), ends)
        alone = np.append(_told(found, "counts", "alone"), 0).astype(bool)
        order = np.argsort(number)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        body = B.dump(ids=c.ids, held=c.held, lengths=B.slim(np.diff(c.at)), sorted_number=number[order], count=B.slim(count[order]), alone=alone[order], tokens=B.slim(rank[c.tokens]))
        return B.rows([(chunk, "state", -1, body)])

    return run


class _State:
    """A chunk as numbers."""

    def __init__(self, body: bytes):
        x = B.load(body)
        self.ids, self.held, self.number, self.count, self.alone = x["ids"], x["held"], x["sorted_number"], x["count"].astype(np.int64), x["alone"]
        self.at = np.concatenate([[0], np.cumsum(x["lengths"].astype(np.int64))])
        self.tokens = x["tokens"].astype(np.int64)
        self.train = ~np.repeat(self.held, np.diff(self.at))
        self.first = np.zeros(len(self.tokens), dtype=bool)
        self.first[self.at[:-1][np.diff(self.at) > 0]] = True


@dataclass
class _Level:
    """A chunk's n-grams of one order, as the tables tell of them.

    gram: each token's n-gram by local number, the last of which stands for all that training
    cannot have; count: their counts; alone: whether no other chunk has them; columns: their
    words, unless nothing is asked above. history: each token's history by local number;
    numbers: gives one of the histories' numbers, such as ``_number`` has them.
    """

    gram: np.ndarray
    count: np.ndarray
    alone: np.ndarray
    columns: list[np.ndarray]
    history: np.ndarray | None = None
    numbers: Callable[[str], np.ndarray] | None = None


NUMBERS = ["size", *[f"{kind}{r}" for kind in "tl" for r in range(SMALL + 1)]]


def _number(name: str, of: np.ndarray, total: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
    """For n histories: ``size``, their occurrences, or their continuations by small counts, their own (t) or of the order below (l); 0: occurrences of the others."""
    if name == "size":
        return np.bincount(of, total, n).astype(np.int64)
    x, r = total if name[0] == "t" else low, int(name[1:])
    if r:
        return np.bincount(of[(total > 0) & (x == r)], minlength=n)
    large = (total > 0) & (x > SMALL)
    return np.bincount(of[large], x[large], n).astype(np.int64)


class _Grams:
    """A chunk's n-grams of the order above a level: those of its own, and what it asks, by bucket of the history."""

    def __init__(self, c: _State, below: _Level, ends: int, n_buckets: int, share: int):
        n, shift = len(c.tokens), len(c.number).bit_length()
        # A history is the n-gram of the order below that ends at the token before. The last
        # one there stands for those that are not known; the one of starts alone comes after.
        known = len(below.count)
        self.history = np.append(known, below.gram[:-1]) if n else below.gram
        self.history[c.first] = known
        self.size = known + 1
        counts, alone = np.append(below.count, ends), np.append(below.alone, False)
        self.columns = [np.append(x, 0) for x in below.columns]
        live = (counts[self.history] > 0) & (below.count[below.gram] > 0)
        pair, by = _sorted(self.history[live] << shift | c.tokens[live])
        new = _new(pair)
        place, pair, at = _places(new, by), pair[new], np.flatnonzero(live)[by[new]]
        self.gram = np.full(n, len(pair))
        self.gram[live] = place
        self.of, word = pair >> shift, pair & ((1 << shift) - 1)
        self.word = c.number[word]
        self.count = np.bincount(place[c.train[live]], minlength=len(pair)).astype(np.int64)
        self.low = below.count[below.gram[at]]
        self.alone = alone[self.of] if len(pair) else np.zeros(0, bool)
        self._deal(np.where((counts > 0) & ~alone, -(-counts // share), 0), n_buckets)

    def _deal(self, shares: np.ndarray, n_buckets: int) -> None:
        """Histories, or their shares, in order of buckets, and the n-grams in order of those.

        A chunk asks for all shares of a history, also those that none of its n-grams is in.
        """
        base = np.cumsum(shares) - shares
        self.unit_of = np.repeat(np.arange(len(shares)), shares)
        self.part = np.arange(len(self.unit_of)) - base[self.unit_of]
        h = np.full(len(self.part), T.mix(np.zeros(1, np.int64), 81))
        hot = np.flatnonzero(self.part)  # few histories have more than one share
        h[hot] = T.mix(self.part[hot], 81)
        for x in self.columns:
            h = T.mix(h ^ x[self.unit_of].astype(U64), 82)
        bucket = (h - h // U64(n_buckets) * U64(n_buckets)).astype(np.int64)
        # Histories are in order of their words already, but for the words' first one.
        order, _ = _ranked(bucket, self.columns[0][self.unit_of].astype(np.int64))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.unit_of, self.part, bucket = self.unit_of[order], self.part[order], bucket[order]
        self.cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
        asked = np.flatnonzero(~self.alone)
        of = self.of[asked]
        at, hot = base[of], np.flatnonzero(shares[of] > 1)
        at[hot] += (T.mix(self.word[asked[hot]], 83) % shares[of[hot]].astype(U64)).astype(np.int64)
        unit = place[at]
        self.order = asked[_sorted(unit)[1]]
        self.to = np.append(0, np.cumsum(np.bincount(unit, minlength=len(self.unit_of))))

    def blocks(self, chunk: int, n_buckets: int) -> pa.RecordBatch:
        out = [(chunk, "alone", chunk % n_buckets, B.dump(stats=_summed(self.count[self.alone])))]
        many = np.diff(self.to)
        for b, (i, j) in enumerate(zip(self.cut, self.cut[1:], strict=False)):
            if j > i:
                own = self.order[self.to[i] : self.to[j]]
                units = {f"{'sorted_' if n == 0 else ''}h{n}": x[self.unit_of[i:j]] if n == 0 else B.slim(x[self.unit_of[i:j]]) for n, x in enumerate(self.columns)}
                out.append((chunk, "grams", b, B.dump(**units, part=B.slim(self.part[i:j]), many=B.slim(many[i:j]), word=B.slim(self.word[own]), count=B.slim(self.count[own]), low=B.slim(self.low[own]))))
        return B.rows(out)

    def answered(self, found: dict, kind: str, last: bool) -> _Level:
        """The level that the tables tell of; what only asking needs goes."""
        told = [B.load(x) for _, x in sorted(found.get(kind, {}).items())]
        take = lambda name: np.concatenate([np.zeros(0, np.int64), *[x[name].astype(np.int64) for x in told]])
        count, alone = np.append(self.count, 0), np.append(self.alone, False)
        count[self.order], alone[self.order] = take("count"), take("alone").astype(bool)
        columns = [] if last else [np.append(x[self.of], 0) for x in self.columns] + [np.append(self.word, 0)]
        mine, unit_of, size = [x[self.alone] for x in (self.of, self.count, self.low)], self.unit_of, self.size

        def numbers(name: str) -> np.ndarray:
            return _number(name, *mine, size) + np.bincount(unit_of, take(name), size).astype(np.int64)

        return _Level(self.gram, count, alone, columns, self.history, numbers)


def _grams(c: _State, found: dict, order: int, ends: int, n_buckets: int, share: int) -> tuple[list[_Level], _Grams]:
    """The levels whose tables are there, and what to ask of the order."""
    none = np.zeros(1, np.int64)
    levels = [_Level(c.tokens, np.append(c.count, 0), np.append(c.alone, False), [np.append(c.number, none)])]
    for k in range(2, order + 1):
        asked = None  # the one of the order below goes first
        asked = _Grams(c, levels[-1], ends, n_buckets, share)
        if k < order or f"model{k}" in found:
            levels.append(asked.answered(found, f"model{k}", k == order))
    return levels, asked


def _ask_grams(order: int, ends: int, n_buckets: int, share: int):
    def run(chunk: int, found: dict | bytes) -> pa.RecordBatch:
        found = found if isinstance(found, dict) else {"state": {-1: found}}
        return _grams(_State(found["state"][-1]), found, order, ends, n_buckets, share)[1].blocks(chunk, n_buckets)

    return run


def _answer_grams(order: int):
    kind = f"model{order}"

    def run(table: pa.Table) -> pa.RecordBatch:
        bucket = table["bucket"][0].as_py()
        loaded = [(c, k, B.load(x)) for c, k, x in zip(*(table[k].to_pylist() for k in ("chunk", "kind", "body")), strict=True)]
        stats = np.sum([np.zeros(SMALL + 4, np.int64), *[x["stats"] for _, k, x in loaded if k == "alone"]], axis=0)
        asked = [(c, x) for c, k, x in loaded if k == "grams"]
        out = []
        if asked:
            columns = [f"{'sorted_' if n == 0 else ''}h{n}" for n in range(order - 1)] + ["part"]
            units = [np.concatenate([x[k].astype(np.int64) for _, x in asked]) for k in columns]
            many, word, count, low = (np.concatenate([x[k].astype(np.int64) for _, x in asked]) for k in ("many", "word", "count", "low"))
            by, new = _ranked(*units)
            unit, n = _places(new, by), int(new.sum())
            of = np.repeat(unit, many)
            by, new = _ranked(of, word)
            at, place = np.flatnonzero(new), _places(new, by)
            total = np.add.reduceat(count[by], at) if len(at) else count
            alone = np.diff(np.append(at, len(by))) == 1
            mine = of[by][at], total, low[by][at], n
            told = {name: _number(name, *mine) for name in NUMBERS}
            stats = stats + _summed(total)
            begin, head = 0, 0
            for c, x in asked:
                own = unit[head : head + len(x["many"])]
                grams = place[begin : begin + len(x["word"])]
                out.append((c, kind, bucket, B.dump(count=B.slim(total[grams]), alone=alone[grams], **{k: B.slim(v[own]) for k, v in told.items()})))
                head, begin = head + len(own), begin + len(grams)
        return B.rows([*out, (-1, "stats", bucket, B.dump(stats=np.append(stats, 0)))])

    return run


def probabilities(levels: list[_Level], lower: Unigrams, d: list[np.ndarray]) -> np.ndarray:
    """Each token's probability, from order 1 upwards: what is not known at an order backs off."""
    prob = lower(levels[0].count[levels[0].gram])
    below, scale_below, own = lower.d, None, None
    for k, level in enumerate(levels[1:]):
        r = range(1, SMALL + 1)
        rest = sum((1 - d[k][x]) * x * level.numbers(f"t{x}") for x in r)
        mass = level.numbers("l0") + sum(below[x] * x * level.numbers(f"l{x}") for x in r)
        whole = level.numbers("size")
        if scale_below is None:
            mass = mass * lower.scale
        else:
            # The history without its first word, at any token that has the history.
            shorter = np.zeros(len(whole), np.int64)
            shorter[level.history] = own
            mass = mass * scale_below[shorter]
        seen = whole > 0
        weight, scale = np.ones(len(seen)), np.zeros(len(seen))
        size, left = whole[seen], np.maximum(rest[seen], 0.5)
        weight[seen] = left / size / (1 - mass[seen])
        scale[seen] = (size - left) / (size - rest[seen]) / size
        count = level.count[level.gram]
        prob = np.where(count > 0, discounted(count, d[k]) * scale[level.history], weight[level.history] * prob)
        below, scale_below, own = d[k], scale, level.history
    return prob


def _score(lower: Unigrams, d: list[np.ndarray], ends: int, n_buckets: int, share: int):
    base = np.log10(lower.n + 0.5 * (lower.types + 1))

    def run(chunk: int, found: dict) -> pa.RecordBatch:
        c = _State(found["state"][-1])
        levels = _grams(c, found, len(d) + 1, ends, n_buckets, share)[0]
        count = c.count[c.tokens]
        n = np.diff(c.at)
        doc = np.repeat(np.arange(len(c.ids)), n)
        total = lambda x: np.bincount(doc, x, len(c.ids))
        return pa.record_batch([
            pa.array(c.ids, pa.int64()), pa.array(c.held), pa.array(n.astype(np.int64)), pa.array(total(count > 0).astype(np.int64)), pa.array(np.full(len(c.ids), lower.n, np.int64)),
            pa.array(total(np.log10(count + 0.5) - base)), pa.array(total(np.log10(probabilities(levels, lower, d)))),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def katz_scores(docs: DataFrame, order: int = ORDER, share: int = SHARE) -> DataFrame:
    """Score all texts with a model of those whose crc32(doc_id as text) mod 5 is not 1.

    docs: doc_id long, text string; other columns are not read. order: words of the longest
    n-grams, 2 or more. Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and one
    end for each text, so null and empty texts have one token; histories before the first
    words are filled up with starts. Returns doc_id, held_out, n_tokens, n_known (tokens that
    training has), train_tokens, base_score (unigrams with half a count added, log10) and
    score (the model's log10 probability). Rows with a null doc_id go; repeated rows count
    each. Without training texts every token is the unknown word. share: occurrences of a
    history for each bucket that it is dealt out to; results do not depend on it.
    """
    if order < 2:
        raise ValueError("order must be at least 2")
    spark = docs.sparkSession
    parts = B.chunks(docs)
    n = B.buckets(parts)
    words = written(B.by_bucket(B.by_row(parts, _ask_words(n)), _answer_words(n)))
    *stats, ends = _stats(words).tolist()
    lower = Unigrams(np.array(stats) + _summed(np.array([ends])))
    release(spark)
    tables = [written(B.by_chunk([parts, words.where("kind = 'counts'")], _encode(ends)))]
    for x in (parts, words):  # the chunks are there as numbers
        discard(x)
    d: list[np.ndarray] = []
    for k in range(2, order + 1):
        release(spark)
        ask = _ask_grams(k, ends, n, share)
        found = written(B.by_bucket(B.by_row(tables[0], ask) if k == 2 else B.by_chunk(tables, ask), _answer_grams(k)))
        d.append(discounts(_stats(found)[2:-1]))
        tables.append(found.where(f"kind = 'model{k}'"))
    release(spark)
    return B.by_chunk(tables, _score(lower, d, ends, n, share), RESULT)
