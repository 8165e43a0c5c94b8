"""License scans by MinHash over overlapping windows, verified by containment.

Each template has a window length of its own, in blocks: an occurrence lies whole in one of
the windows that begin at each block. A text's block minima under BANDS hash functions are
found level by level, each level's blocks being two of the one below; a window's MinHash
values are minima over its blocks. A window whose value in some band stands in the band's
table retrieves the templates listed there. Only those are verified: a window counts if it
holds enough of the template's distinct shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .text import U64

SHINGLE, SHARE = 5, 0.8
#: Bands of one value each, and the chance of missing a window that the bands must stay below (see ``Template.miss``).
BANDS, MISS = 24, 1e-6

# Public license notices.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
#: Most words that all templates together may have: their tables go to every task.
TEMPLATE_WORDS = 200_000
RESULT = "doc_id long, licenses array<string>, matches array<struct<license:string,start:long,stop:long,containment:double>>"


def _shingles(words: np.ndarray, others: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names of shingles, from both names of each word."""
    return T.mix(T.chained(words, at, SHINGLE, 71) ^ T.chained(others, at, SHINGLE, 81))


def _values(shingles: np.ndarray, band: int) -> np.ndarray:
    """A band's hash function: shingles are names already, so a multiplication reorders them."""
    return shingles * _FACTORS[band]


_FACTORS = T.mix(np.arange(BANDS), 91) | U64(1)


class Template:
    def __init__(self, license: str, words: np.ndarray, others: np.ndarray):
        self.license = license
        places = len(words) - SHINGLE + 1
        self.shingles = np.unique(_shingles(words, others, np.arange(places)))
        self.needed = -(-int(SHARE * 100) * len(self.shingles) // 100)
        # Blocks of a quarter of the template at most, a power of two; one block more than it can touch.
        self.level = max(0, (max(places, 1) // 4).bit_length() - 1)
        self.blocks = -(-(places - 1) // (1 << self.level)) + 1
        self.bands = np.array([_values(self.shingles, k).min() for k in range(BANDS)])

    @property
    def width(self) -> int:
        """Shingles of a window."""
        return self.blocks << self.level

    @property
    def miss(self) -> float:
        """The chance that a window with just enough of the template's shingles, and others elsewhere, shares no band."""
        least = self.needed / (len(self.shingles) + self.width - self.needed)
        return (1 - least) ** BANDS


class Tables:
    """For each window length and band: the values of the templates, and which templates have them."""

    def __init__(self, templates: list[Template]):
        self.templates = templates
        self.shapes: dict[tuple[int, int], tuple[np.ndarray, list, np.ndarray]] = {}
        for shape in sorted({(t.level, t.blocks) for t in templates}):
            own = np.array([k for k, t in enumerate(templates) if (t.level, t.blocks) == shape])
            bands = np.stack([templates[k].bands for k in own])
            orders = [np.argsort(bands[:, k], kind="stable") for k in range(BANDS)]
            # A first look by the upper bits of a value.
            look = np.zeros((BANDS, 1 << 16), dtype=bool)
            look[np.arange(BANDS), (bands >> U64(48)).astype(np.int64)] = True
            self.shapes[shape] = (look, [(bands[o, k], own[o]) for k, o in enumerate(orders)], own)


def build(templates: dict[str, list[str]]) -> Tables:
    out, total = [], 0
    for name in sorted(templates):
        for text in templates[name]:
            w = T.words(*T.buffers(pa.array([text])), T.ALNUM, lower=True)
            total += len(w)
            if len(w) < SHINGLE:
                raise ValueError(f"a template of {name} has fewer than {SHINGLE} words")
            out.append(Template(name, w.hashes, w.others))
            if out[-1].miss > MISS:
                raise ValueError(f"{BANDS} bands may miss a template of {name}")
    if total > TEMPLATE_WORDS:
        raise ValueError(f"templates have {total} words; {TEMPLATE_WORDS} at most: scan in several calls")
    return Tables(out)


def _candidates(h: np.ndarray, places: np.ndarray, tables: Tables) -> np.ndarray:
    """Distinct (template, document, block) whose window shares a band, from shingles in order and their number by document.

    At each level a document's blocks are followed by as many empty ones as a window can
    reach, so that windows end with their document.
    """
    none = U64(2**64 - 1)
    top = max(level for level, _ in tables.shapes)
    levels, count, before = [], places, None
    for level in range(top + 1):
        reach = max([blocks for at, blocks in tables.shapes if at == level], default=0)
        head = np.cumsum(count + reach) - count - reach
        place = np.repeat(head, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        # A block is two of the level below; what follows a document's last one there is empty.
        starts = None if before is None else np.repeat(before, count) + 2 * (place - np.repeat(head, count))
        levels.append((head, place, int((count + reach).sum()), starts))
        count, before = -(-count // 2), head
    found = [np.zeros((0, 3), np.int64)]
    for band in range(BANDS):
        minima = _values(h, band)
        for level, (head, place, size, starts) in enumerate(levels):
            own = np.full(size, none)
            own[place] = minima if starts is None else np.minimum.reduceat(minima, starts)
            minima = own
            spans = {1: own}
            for (at, blocks), (look, lists, _) in tables.shapes.items():
                if at != level:
                    continue
                # A window's value: the least of its blocks, from minima of 1, 2, 4 and so on.
                half = 1 << (blocks.bit_length() - 1)
                for k in range(1, half.bit_length()):
                    if 1 << k not in spans:
                        low = spans[1 << (k - 1)]
                        spans[1 << k] = np.minimum(low, np.append(low[1 << (k - 1) :], np.full(min(len(low), 1 << (k - 1)), none)))
                least, shift = spans[half], blocks - half
                if shift:
                    least = np.minimum(least[: len(least) - shift], least[shift:])
                hit = np.flatnonzero(look[band][(least >> U64(48)).astype(np.uint16)])
                keys, which = lists[band]
                a, z = np.searchsorted(keys, least[hit], side="left"), np.searchsorted(keys, least[hit], side="right")
                n = z - a
                row = np.repeat(hit, n)
                if len(row):
                    template = which[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    doc = np.searchsorted(head, row, side="right") - 1
                    found.append(np.stack([template, doc, row - head[doc]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def matches(words: np.ndarray, others: np.ndarray, offsets: np.ndarray, tables: Tables) -> list[tuple[int, str, int, int, float]]:
    """(document, license, first word, end, containment) of the windows that hold a template."""
    found: list[tuple[int, str, int, int, float]] = []
    places = np.maximum(np.diff(offsets) - SHINGLE + 1, 0)
    if not places.sum() or not tables.shapes:
        return found
    base = np.cumsum(places) - places
    at = np.repeat(offsets[:-1], places) + np.arange(places.sum()) - np.repeat(base, places)
    h = _shingles(words, others, at)
    candidates = _candidates(h, places, tables)
    for k in np.unique(candidates[:, 0]).tolist():
        t = tables.templates[k]
        own = candidates[candidates[:, 0] == k][:, 1:]
        step = max(1, (1 << 20) // t.width)
        for part in (own[i : i + step] for i in range(0, len(own), step)):  # a bounded number of shingles at once
            first = part[:, 1] << t.level
            inside = first[:, None] + np.arange(t.width) < places[part[:, 0]][:, None]
            mine = h[np.minimum((base[part[:, 0]] + first)[:, None] + np.arange(t.width), len(h) - 1)]
            rank = np.minimum(np.searchsorted(t.shingles, mine), len(t.shingles) - 1)
            hit = inside & (t.shingles[rank] == mine)
            seen = np.sort(np.where(hit, rank, -1), axis=1)
            held = ((seen[:, 1:] != seen[:, :-1]) & (seen[:, 1:] >= 0)).sum(axis=1) + (seen[:, 0] >= 0)
            for row in np.flatnonzero(held >= t.needed).tolist():
                spots = np.flatnonzero(hit[row])
                found.append((int(part[row, 0]), t.license, int(first[row] + spots[0]), int(first[row] + spots[-1] + SHINGLE), float(held[row] / len(t.shingles))))
    return found


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Licenses whose notices stand in documents: doc_id, licenses (sorted), matches.

    docs: doc_id long, text string; other columns are not read. Words are
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; shingles are five words; a window
    of a template begins at each of its blocks (see ``Template``) and matches if it holds 0.8
    or more of the template's distinct shingles. matches has one entry for each license and
    stretch of words, from the first to the last shingle found: of those that overlap or touch the one of
    best containment, then the first, then the shortest. A matching window is missed with a
    chance of MISS at most. Every document is returned; null, empty and short texts match nothing; rows
    with a null doc_id go; repeated rows are scanned each.
    """
    tables = docs.sparkSession.sparkContext.broadcast(build(TEMPLATES if templates is None else templates))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    entry = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = T.buffers(b.column("text"))
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for a, z in T.slices(offs):
                found = T.all_names(*T.of_range(data, offs, a, z), T.ALNUM, lower=True)
                each: list[list[dict]] = [[] for _ in range(z - a)]
                for d, name, start, stop, share in sorted(matches(*found, tables.value), key=lambda x: (x[0], x[1], x[2], -x[4], x[3])):
                    last = each[d][-1] if each[d] else None
                    if last and last["license"] == name and start <= last["stop"]:
                        if share > last["containment"]:
                            last |= {"start": start, "stop": stop, "containment": share}
                        continue
                    each[d].append({"license": name, "start": start, "stop": stop, "containment": share})
                names = [sorted({m["license"] for m in x}) for x in each]
                yield pa.record_batch([pa.array(ids[a:z], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(each, entry)], names=["doc_id", "licenses", "matches"])

    return picked.mapInArrow(run, RESULT)
