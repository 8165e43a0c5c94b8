"""Locally consistent parsing by recompression."""

from __future__ import annotations

import numpy as np

from .text import U64, mix


def parse(tokens: np.ndarray, offsets: np.ndarray, rounds: int = 5):
    """Parse each document by ``rounds`` of run naming and pair naming.

    A round names each maximal run of equal symbols, then each adjacent pair whose first
    symbol is of the left half and whose second is of the right half of the alphabet; a
    symbol's half in a round is a bit of its hash. Names are 64-bit hashes of what they
    stand for, so they are the same for equal content everywhere, with no dictionary to
    send around.

    Returns (names, left, right) of the symbols: words left..right-1 alone determine that
    the symbol stands there. Where the document's edge took part, left or right lies
    outside the document, so no window inside it determines the symbol. Hence equal
    windows hold the same determined symbols at the same places.
    """
    n = len(tokens)
    name = mix(tokens, 101)
    left, right = np.arange(n, dtype=np.int64), np.arange(1, n + 1, dtype=np.int64)
    head = np.zeros(n + 1, dtype=bool)
    head[offsets] = True
    head = head[:n].copy()
    for k in range(rounds):
        n = len(name)
        if not n:
            break
        # Runs. That a symbol ends its run depends on its neighbours.
        tail = np.append(head[1:], True)
        before = np.where(head, left - 1, np.append(left[:1], left[:-1]))
        after = np.where(tail, right + 1, np.append(right[1:], right[-1:]))
        new = np.empty(n, dtype=bool)
        new[0] = True
        np.not_equal(name[1:], name[:-1], out=new[1:])
        new |= head
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, n))
        end = at + size - 1
        run = size > 1
        name = name[at]
        name[run] = mix(name[run] ^ mix(size[run].astype(U64), 7 + k), 11 + k)
        left, right, head = np.minimum(left[at], before[at]), np.maximum(right[end], after[end]), head[at]
        # Pairs. That a left symbol stays alone depends on the next one, a right symbol on the one before.
        n = len(name)
        half = (mix(name, 1009 + k) >> U64(17)) & U64(1) == 0
        tail = np.append(head[1:], True)
        first = np.zeros(n, dtype=bool)
        first[:-1] = half[:-1] & ~half[1:] & ~head[1:]
        second = np.append(False, first[:-1])
        alone_l, alone_r = half & ~first, ~half & ~second
        after = np.where(tail, right + 1, np.append(right[1:], right[-1:]))
        before = np.where(head, left - 1, np.append(left[:1], left[:-1]))
        joined = np.flatnonzero(first)
        name[joined] = mix(name[joined] ^ mix(name[joined + 1], 31 + k), 37 + k)
        new_right = np.where(alone_l, np.maximum(right, after), right)
        new_left = np.where(alone_r, np.minimum(left, before), left)
        new_right[joined] = np.maximum(right[joined], right[joined + 1])
        new_left[joined] = np.minimum(left[joined], left[joined + 1])
        keep = ~second
        name, left, right, head = name[keep], new_left[keep], new_right[keep], head[keep]
    return name, left, right


def open_windows(left: np.ndarray, right: np.ndarray, blocked: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """Which windows of ``window`` words inside a document hold no blocked symbol.

    blocked: of the symbols given by left and right, those that occur in one text only.
    """
    n = int(offsets[-1])
    marks = np.zeros(n + 1, dtype=np.int64)
    l, r = left[blocked], right[blocked]
    fits = (r - l <= window) & (l >= 0)
    l, r = l[fits], r[fits]
    np.add.at(marks, np.maximum(r - window, 0), 1)
    np.add.at(marks, np.minimum(l + 1, n), -1)
    free = np.cumsum(marks)[:n] == 0
    spare = np.zeros(n + 1, dtype=np.int64)
    lo, hi = np.maximum(offsets[1:] - window + 1, offsets[:-1]), offsets[1:]
    np.add.at(spare, lo, 1)
    np.add.at(spare, hi, -1)
    return free & (np.cumsum(spare)[:n] == 0)
