"""Vectorised word splitting and hashing over UTF-8 buffers.

Every function works on whole texts: a batch of documents is one byte array plus the
offsets of its documents, and words are found by byte class, which is exact for UTF-8
because the separators of all word definitions used here are ASCII.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library has no such call
    _libc = None

U64 = np.uint64
_PRIME, _LOW31, _LOW30 = U64((1 << 61) - 1), U64((1 << 31) - 1), U64((1 << 30) - 1)
_BASES = (0x0E3779B97F4A7C15, 0x14D049BB133111EB)
_known_powers: dict[int, np.ndarray] = {}
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)
#: Longest string, in bytes, whose names are made by steps of eight bytes.
LONG = 256


def _class(separators: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words ``[^\x20\x09-\x0D]+``.
SPACED = _class(bytes([0x20, *range(0x09, 0x0E)]))
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after A-Z are lower-cased).
ALNUM = _class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: Lines: everything but the line feed.
LINES = _class(b"\n")

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = np.asarray(x, dtype=U64) + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of the bytes data[start:end]: together they stand for the content.

    Eight bytes a step go through a chain of bijections, one chain for each name, so strings
    of eight bytes or less cannot collide with others of their length, and longer ones do so
    by chance alone (in both names at once: 2^-128). Strings longer than LONG go through BLAKE2.
    """
    n = ends - starts
    out = mix(n, 11), mix(n, 12)
    if not len(n):
        return out
    lane = _lanes(data)
    live = np.flatnonzero((n > 0) & (n <= LONG))
    at, left = starts[live], n[live]
    while len(live):
        part = lane[at] & _MASKS[np.minimum(left, 8)]
        for k, h in enumerate(out):
            h[live] = mix(h[live] ^ part, 13 + k)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(n > LONG).tolist():
        both = hashlib.blake2b(data[starts[k] : ends[k]], digest_size=16).digest()
        out[0][k], out[1][k] = np.frombuffer(both, U64)
    return out


def chained(values: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of the ``size`` values that begin at each place, by a chain of bijections."""
    h = np.full(len(at), seed, dtype=U64)
    for k in range(size):
        h = mix(h ^ values[at + k], seed + k)
    return h


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, of numbers below it."""
    a1, a0, b1, b0 = a >> U64(31), a & _LOW31, b >> U64(31), b & _LOW31
    mid = a1 * b0 + a0 * b1
    total = U64(2) * a1 * b1 + (mid >> U64(30)) + ((mid & _LOW30) << U64(31)) + a0 * b0
    total = (total & _PRIME) + (total >> U64(61))
    return np.where(total >= _PRIME, total - _PRIME, total)


def _powers(n: int, base: int) -> np.ndarray:
    have = _known_powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, dtype=U64)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, _times(have, U64(pow(base, len(have), int(_PRIME))))])
        _known_powers[base] = have
    return have[:n]


def segment_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int = 0) -> np.ndarray:
    """A hash of values[start:end] for each pair, whatever its place: a polynomial modulo the prime 2^61 - 1."""
    n = len(values)
    part = _times(mix(values, 31 + k) >> U64(3), _powers(n, _BASES[k])) if n else np.zeros(0, U64)
    high, low = np.zeros(n + 1, U64), np.zeros(n + 1, U64)
    np.cumsum(part >> U64(32), out=high[1:])
    np.cumsum(part & U64(0xFFFFFFFF), out=low[1:])
    high, low = high[ends] - high[starts], low[ends] - low[starts]
    # high * 2^32 modulo the prime: 2^61 is 1.
    total = (high >> U64(29)) + ((high & U64((1 << 29) - 1)) << U64(32))
    total = (total & _PRIME) + (total >> U64(61)) + (low & _PRIME)
    total = (total & _PRIME) + (total >> U64(61))
    total = np.where(total >= _PRIME, total - _PRIME, total)
    moved = _times(total, _powers(n + 1, pow(_BASES[k], -1, int(_PRIME)))[starts])
    return mix(moved ^ (mix(ends - starts, 33 + k)), 35 + k)


def trim() -> None:
    """Give freed memory back to the system: workers live long, and their allocators keep what arrays leave."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


class Words:
    """Words of a batch: byte spans, two 64-bit names and each document's range of words."""

    __slots__ = ("data", "starts", "ends", "offsets", "hashes", "others")

    def __init__(self, data, starts, ends, offsets, hashes, others):
        self.data, self.starts, self.ends, self.offsets, self.hashes, self.others = data, starts, ends, offsets, hashes, others

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offs[0] : offs[-1]], offs - offs[0]


def spans(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words, and the word range of each document."""
    inside = kind[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offs[:-1]
    first[heads[heads < n]] = inside[heads[heads < n]]
    tails = offs[1:]
    tails = tails[tails > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray = SPACED, lower: bool = False) -> Words:
    if lower:
        data = LOWER[data]
    starts, ends, at = spans(data, offs, kind)
    return Words(data, starts, ends, at, *names(data, starts, ends))


def slices(offs: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document is a range of its own."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def of_range(data: np.ndarray, offs: np.ndarray, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    return data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]


def all_names(data: np.ndarray, offs: np.ndarray, kind: np.ndarray = SPACED, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both names of the words of many documents and the word range of each, by slices of bounded size."""
    found, others, counts = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(1, np.int64)]
    for at, to in slices(offs):
        w = words(*of_range(data, offs, at, to), kind, lower)
        found.append(w.hashes)
        others.append(w.others)
        counts.append(w.counts())
    return np.concatenate(found), np.concatenate(others), np.cumsum(np.concatenate(counts))


def all_words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray = SPACED, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The first names of the words of many documents and the word range of each."""
    first, _, at = all_names(data, offs, kind, lower)
    return first, at
