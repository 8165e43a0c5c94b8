"""Token ids of a public word tokenizer, with each distinct word encoded about once a task."""

from __future__ import annotations

import numpy as np

from . import text as T
from .text import U64

_SLOTS = 20
_FLAT = 1 << 24

#: Bytes that split texts into pieces that this tokenizer encodes independently of each other.
_TAIL = np.zeros(256, dtype=bool)
_TAIL[list(b".,;:!?")] = True
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file: its table lives as long as the process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """Exact ids of a lower-casing tokenizer that drops white space.

    A text's ids are those of its pieces in order, where pieces end at ASCII white space
    and before a final run of ``.,;:!?`` that follows an ASCII letter or digit. ASCII
    letters are lower-cased beforehand, unless a byte of another character follows (a
    combining mark could join them) or the batch holds ``<|``, which special tokens begin
    with. Pieces are looked up in a table of fixed size; only the others are encoded.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = None
        if hasattr(self.tokenizer, "encode_batch_fast") and any(x.endswith("</w>") for x in vocab):
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.ends[[v for k, v in vocab.items() if k.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.keys, self.others = np.zeros(1 << _SLOTS, dtype=U64), np.zeros(1 << _SLOTS, dtype=U64)
        self.at = np.zeros(1 << _SLOTS, dtype=np.int64)
        self.size = np.full(1 << _SLOTS, -1, dtype=np.int32)
        self.flat = np.zeros(1 << 20, dtype=np.uint32)
        self.used = 0

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of pieces in a row, and how many each has.

        Pieces of lower-case letters alone are one word each, whose last token alone has the
        word-end mark; so they are encoded as one text and cut at the marks.
        """
        plain = [k for k, x in enumerate(texts) if x.isalpha() and x == x.lower()]
        if len(plain) < 16 or self.ends is None:
            return self._each(texts)
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[k] for k in plain])], add_special_tokens=False)[0].ids, dtype=np.uint32)
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) != len(plain) or not len(cut) or cut[-1] != len(ids):
            return self._each(texts)
        sizes = np.zeros(len(texts), np.int64)
        sizes[plain] = np.diff(cut, prepend=0)
        chosen = np.zeros(len(texts), bool)
        chosen[plain] = True
        rest = np.flatnonzero(~chosen)
        other, sizes[rest] = self._each([texts[k] for k in rest])
        first = np.zeros(len(texts), np.int64)
        first[plain] = cut - sizes[plain]
        first[rest] = len(ids) + np.cumsum(sizes[rest]) - sizes[rest]
        return gather(np.concatenate([ids, other]), first, sizes), sizes

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        ids = [x.ids for x in run(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((y for x in ids for y in x), np.uint32, int(sizes.sum())), sizes

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all documents in a row, and each document's bounds in them."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        low = data
        if data.tobytes().find(b"<|") < 0:
            low = np.where(np.append(data[1:], 0) < 0x80, T.LOWER[data], data)
        starts, ends, at = T.spans(low, offs, T.SPACED)
        # A final run of marks after a plain character is a piece of its own.
        cut = ends.copy()
        last = _TAIL[low]
        going = last[ends - 1]
        while going.any():
            cut = cut - going
            going = going & (cut > starts) & last[np.maximum(cut - 1, 0)]
        apart = (cut > starts) & (cut < ends) & _PLAIN[low[np.maximum(cut - 1, 0)]]
        cut = np.where(apart, cut, ends)
        order = np.cumsum(1 + apart) - (1 + apart)
        n = len(starts) + int(apart.sum())
        s, e = np.empty(n, np.int64), np.empty(n, np.int64)
        s[order], e[order] = starts, cut
        s[order[apart] + 1], e[order[apart] + 1] = cut[apart], ends[apart]
        where = np.append(order, n)[at]
        # A piece is known by both its names, which together stand for its bytes.
        h, rest = T.names(low, s, e)
        slot = (h >> U64(64 - _SLOTS)).astype(np.int64)
        known = (self.keys[slot] == h) & (self.others[slot] == rest) & (self.size[slot] >= 0)
        first, size = self.at[slot], self.size[slot].astype(np.int64)
        miss = np.flatnonzero(~known)
        if len(miss):
            which, back = distinct(h[miss], rest[miss])
            new, more = h[miss[which]], rest[miss[which]]
            raw = low.tobytes()
            flat, sizes = self._encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(s[miss[which]].tolist(), e[miss[which]].tolist(), strict=True)])
            if self.used + len(flat) > _FLAT:
                kept = self.flat  # what this batch refers to stays valid: old ids are copied behind
                pick = np.flatnonzero(known)
                old, inv = np.unique(slot[pick], return_inverse=True)
                a, z = self.at[old], self.size[old].astype(np.int64)
                own, others = self.keys[old], self.others[old]
                self._reset()
                self._add(own, others, gather(kept, a, z), z)
                first[pick] = self.at[old][inv]
            begin = self._add(new, more, flat, sizes)
            first[miss], size[miss] = begin[back], sizes[back]
        ids = gather(self.flat, first, size)
        bounds = np.concatenate([[0], np.cumsum(size)])[where]
        return ids, bounds

    def _add(self, keys: np.ndarray, others: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if self.used + len(flat) > len(self.flat):
            grown = np.zeros(max(2 * len(self.flat), self.used + len(flat)), np.uint32)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : self.used + len(flat)] = flat
        begin = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        slot = (keys >> U64(64 - _SLOTS)).astype(np.int64)
        # Where several keys share a slot, one of them takes it.
        own, held = np.unique(slot, return_index=True)
        self.keys[own], self.others[own], self.at[own], self.size[own] = keys[held], others[held], begin[held], sizes[held]
        return begin


def distinct(first: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different pair of names stands, in order of names, and the place of each among them."""
    _, at, place = np.unique(first, return_index=True, return_inverse=True)
    if (other[at][place] == other).all():
        return at, place
    order = np.lexsort((other, first))  # one first name stands for two strings
    new = np.append(True, (first[order][1:] != first[order][:-1]) | (other[order][1:] != other[order][:-1]))
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[first:first+size] of all, one behind the other."""
    total = int(size.sum())
    step = np.ones(total, dtype=np.int64)
    live = size > 0
    first, size = first[live], size[live]
    if not total:
        return flat[:0]
    step[0] = first[0]
    step[np.cumsum(size)[:-1]] = first[1:] - first[:-1] - size[:-1] + 1
    return flat[np.cumsum(step)]
