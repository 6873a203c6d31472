"""License scans: MinHash bands over sliding word windows retrieve templates, exact shingle containment verifies.

A template is a license notice; its words are lower-cased without marks. For
every length class (templates whose number of shingles is alike) a window of
that many shingles slides over a document one word at a time, and its MinHash
values are sliding minima, found for all windows at once by doubling. A window
and a template that share a band are a candidate pair. With bands of one value
and values values, a window of Jaccard similarity s meets its template with
probability 1 - (1 - s) ** values: at the least similarity that the containment
bound allows, 0.66, and 12 values that is above 1 - 3e-6, and a window that
holds the template whole always meets it. A candidate's region is then verified:
the share of the template's shingles in it (containment) must reach the
threshold, and the text it covers is returned. Licenses whose wordings are alike
(versions of one, or one with a clause more) match the same words: of those only
the best match stays.

Templates of fewer words than a shingle are one shingle of all their words and
aren't matched here. Equal matches: the template that comes first. Nulls: a null text is an empty one and has no license; a
null doc_id is returned as it is. Repeated rows each give their rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm.shared import ready
from larkspur.llm.words import MUL, Words, mix, steps, strings

#: Short notices of public licenses by their SPDX identifiers.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "SPDX-License-Identifier: Apache-2.0 Apache License",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "LGPL": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


@dataclass(frozen=True)
class LicenseScan:
    words: int = 3
    values: int = 12
    containment: float = 0.8


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    out = h.copy()
    for k in range(1, size):
        out = out[:-1] * MUL + h[k:] if len(out) > 1 else out[:0]
    return mix(out)


class Library:
    """The templates' shingles and, by length class, their MinHash values."""

    def __init__(self, templates: dict[str, Sequence[str]], p: LicenseScan) -> None:
        self.p = p
        r = np.random.default_rng(23)
        self.mul = (r.integers(0, 2**31, p.values, dtype=np.int64) * 2 + 1).astype(np.uint32)
        self.xor = r.integers(0, 2**32, p.values, dtype=np.int64).astype(np.uint32)
        self.names: list[tuple[str, int]] = []
        self.shingles: list[np.ndarray] = []
        for name, texts in templates.items():
            for n, t in enumerate(texts):
                v = rolled(Words([t]).hash, p.words)
                if len(v):
                    self.names.append((name, n))
                    self.shingles.append(v)
        # classes: a window length for the templates from it up to a quarter longer
        self.classes: list[tuple[int, list[int]]] = []
        for k in sorted(range(len(self.shingles)), key=lambda k: len(self.shingles[k])):
            if self.classes and len(self.shingles[k]) <= self.classes[-1][0] * 1.25:
                self.classes[-1][1].append(k)
            else:
                self.classes.append((len(self.shingles[k]), [k]))
        self.sorted = [np.unique(v) for v in self.shingles]
        self.bands = []
        for _, members in self.classes:
            rows = []
            for j in range(p.values):
                least = np.array([self.value(self.sorted[k], j).min() for k in members], np.uint32)
                order = np.argsort(least)
                rows.append((least[order], np.array(members)[order]))
            self.bands.append(rows)

    def value(self, x: np.ndarray, j: int) -> np.ndarray:
        v = ((x >> np.uint64(32)).astype(np.uint32) ^ self.xor[j]) * self.mul[j]
        return v ^ (v >> np.uint32(15))


def sliding_least(levels: list[np.ndarray], length: int) -> np.ndarray:
    """Minima of windows, from minima of power-of-two windows."""
    top = length.bit_length() - 1
    a = levels[top]
    n = len(levels[0]) - length + 1
    return np.minimum(a[:n], a[length - (1 << top) : length - (1 << top) + n])


def contained(at: np.ndarray, values: np.ndarray, reach: int, whole: int, least: float) -> list[tuple[int, int, float]]:
    """(first, last, share) of windows that begin at a place, reach so far, and hold the least share of distinct values of the whole; the next one begins behind the last. Both ends move forward only, so time follows the number of places."""
    kind = np.unique(values, return_inverse=True)[1].tolist()
    place = at.tolist()
    count = [0] * (max(kind, default=0) + 1)
    out, distinct, right, last_end = [], 0, 0, -1
    for left, s in enumerate(place):
        while right < len(place) and place[right] <= s + reach:
            distinct += count[kind[right]] == 0
            count[kind[right]] += 1
            right += 1
        if s > last_end and distinct >= least * whole:
            last_end = place[right - 1]
            out.append((s, last_end, distinct / whole))
        count[kind[left]] -= 1
        distinct -= count[kind[left]] == 0
    return out


def matches(texts: list[str], lib: Library) -> list[tuple[int, int, float, int, int]]:
    """(text, template, containment, first word, end word) of the verified regions, the best of overlapping ones of a template."""
    p = lib.p
    w = Words(texts)
    sh = rolled(w.hash, p.words)
    if not len(sh):
        return []
    found: list[np.ndarray] = []
    longest = max((c[0] for c in lib.classes), default=0)
    pad = np.full(longest, np.uint32(0xFFFFFFFF))
    for j in range(p.values):
        levels = [np.concatenate([lib.value(sh, j), pad])]
        while 2 << (len(levels) - 1) <= longest:
            half = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        for c, (length, _) in enumerate(lib.classes):
            least = sliding_least(levels, length)[: len(sh)]
            value, member = lib.bands[c][j]
            k = np.searchsorted(value, least)
            hit = value[np.minimum(k, len(value) - 1)] == least
            at = np.flatnonzero(hit)
            k = k[at]
            while len(at):
                found.append(np.stack([member[k], at], 1))
                k = k + 1
                more = (k < len(value)) & (value[np.minimum(k, len(value) - 1)] == least[at])
                at, k = at[more], k[more]
    if not found:
        return []
    pairs = np.unique(np.concatenate(found), axis=0)
    text_of = np.searchsorted(w.first, np.arange(len(w.hash)), side="right") - 1
    out = []
    for t in np.unique(pairs[:, 0]).tolist():
        at = pairs[pairs[:, 0] == t, 1]
        own, size = lib.sorted[t], len(lib.shingles[t])
        # candidate windows of one template that touch are one region, widened by half a template
        breaks = np.flatnonzero((np.diff(at) > size) | (text_of[at[1:]] != text_of[at[:-1]])) + 1
        for g in np.split(at, breaks):
            d = int(text_of[g[0]])
            lo = max(int(g[0]) - size // 2, int(w.first[d]))
            hi = min(int(g[-1]) + size + size // 2 + 1, int(w.first[d + 1]) - p.words + 1)
            if hi <= lo:
                continue
            inside = np.flatnonzero(np.isin(sh[lo:hi], own))
            out += [(d, t, share, lo + s - int(w.first[d]), lo + e + p.words - int(w.first[d])) for s, e, share in contained(inside, sh[lo + inside], size + size // 4, len(own), p.containment)]
    return apart(out, lib)


def apart(found: list[tuple[int, int, float, int, int]], lib: Library) -> list[tuple[int, int, float, int, int]]:
    """Of matches that cover the same words (more than half of the shorter one's) the one that explains most: its template's shingles that are there less those that aren't; then the better contained, then the first template."""
    worth = sorted(set(found), key=lambda x: (x[0], -(2 * x[2] - 1) * len(lib.sorted[x[1]]), -x[2], x[1], x[3]))
    kept: list[tuple[int, int, float, int, int]] = []
    own: list[tuple[int, int]] = []  # by place; those that overlap a match begin at most the longest match before it
    longest = max((x[4] - x[3] for x in worth), default=0)
    for x in worth:
        if kept and kept[-1][0] != x[0]:
            own = []
        near = own[bisect_left(own, (x[3] - longest, 0)) : bisect_left(own, (x[4], 0))]
        if all(2 * (min(e, x[4]) - max(s, x[3])) <= min(e - s, x[4] - x[3]) for s, e in near):
            kept.append(x)
            insort(own, (x[3], x[4]))
    return sorted(kept)


def _scan(batches: Iterator[pa.RecordBatch], lib: Library) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = strings(batch["text"])
        for a, b in steps(texts, 2_000_000):
            rows = matches(texts[a:b], lib)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].take(pa.array([a + r[0] for r in rows], pa.int64())), "license": pa.array([lib.names[r[1]][0] for r in rows], pa.string()), "template": pa.array([lib.names[r[1]][1] for r in rows], pa.int32()), "containment": pa.array([round(r[2], 6) for r in rows], pa.float64()), "first_word": pa.array([r[3] for r in rows], pa.int32()), "end_word": pa.array([r[4] for r in rows], pa.int32())})


def scan(docs: DataFrame, templates: dict[str, Sequence[str]] = TEMPLATES, p: LicenseScan = LicenseScan()) -> DataFrame:
    """Rows doc_id, license, template (its number), containment, first_word, end_word."""
    ready(docs.sparkSession)
    lib = Library(templates, p)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: _scan(it, lib), f"doc_id {kind}, license string, template int, containment double, first_word int, end_word int")
