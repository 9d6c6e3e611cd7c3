"""License scans: MinHash bands over overlapping text windows retrieve templates, containment verifies them.

Words are lower-cased, punctuation parts them, and runs of five are shingles (a
template or text with fewer words is one shingle). Templates are put in classes
by length; a class has one window length, a stride of an eighth of it, and as
many bands of one MinHash value each as make a window collide with a template
that is contained to `least` with probability `sure` at the worst alignment. A
window that shares a band with a template retrieves it; the share of the
template's shingles found around the window is then counted exactly.

Templates are a fixed, small list, so they travel with the code and no row is
shuffled. Null and empty texts match nothing; repeated rows match alike.
"""

from __future__ import annotations

import math
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_columns
from .shingles import shingles

# Notices by which works state their licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)

_PARTS = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
WIDTH = 5


def _normal(text: str) -> str:
    return text.encode().translate(_PARTS).decode()


def bands_for(window: int, stride: int, shortest: int, longest: int, least: float, sure: float) -> int:
    """Bands of one value that make the worst-placed contained template of shortest..longest shingles collide."""
    worst = 1.0
    for t in range(shortest, longest + 1):
        # the nearest window misses at most half a stride of it, and what exceeds the window
        inside = max(1, math.ceil(least * t) - stride // 2 - max(0, t - window))
        worst = min(worst, inside / (window + t - inside))
    return 1 if worst >= 1 else math.ceil(math.log(1 - sure) / math.log(1 - worst))


class Scanner:
    def __init__(self, templates=TEMPLATES, least: float = 0.75, sure: float = 0.999):
        self.least = least
        self.names = [n for n, _ in templates]
        self.sets = [np.unique(shingles(_normal(t), WIDTH)) for _, t in templates]
        order = sorted(range(len(self.sets)), key=lambda i: -len(self.sets[i]))
        groups: list[list[int]] = []
        for i in order:  # lengths within a quarter share a window
            if groups and 5 * len(self.sets[i]) >= 4 * len(self.sets[groups[-1][0]]):
                groups[-1].append(i)
            else:
                groups.append([i])
        #: (window, stride, for each band its sorted values and their templates)
        self.classes = []
        for members in groups:
            window, shortest = len(self.sets[members[0]]), len(self.sets[members[-1]])
            stride = max(1, window // 8)
            tables = []
            for b in range(bands_for(window, stride, shortest, window, least, sure)):
                values = np.array([_permuted(self.sets[i], b).min() for i in members], np.uint64)
                by_value = np.argsort(values, kind="stable")
                tables.append((values[by_value], np.array(members)[by_value]))
            self.classes.append((window, stride, tables))

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, float, int, int]]]:
        """For each text (license, containment, first word, last word + 1): the best place of each license, in text order.

        Windows run over the shingles of all texts in a row; one that reaches
        into the next text can only retrieve more than it need.
        """
        each = [shingles(_normal(t), WIDTH) if t else np.zeros(0, np.uint64) for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in each])]).astype(np.int64)
        s = np.concatenate([*each, np.zeros(0, np.uint64)])
        if not len(s):
            return [[] for _ in texts]
        tries: set[tuple[int, int, int]] = set()
        for band in range(max(len(t) for _, _, t in self.classes)):
            size, minima = 1, _permuted(s, band)
            for window, stride, tables in sorted(self.classes, key=lambda c: c[0]):
                if band >= len(tables):
                    continue
                w = min(window, len(s))
                while 2 * size <= w:  # minima of runs of `size`, shared by all classes
                    minima = np.minimum(minima[:-size], minima[size:])
                    size *= 2
                starts = np.append(np.arange(0, len(s) - w, stride), len(s) - w)
                found = np.minimum(minima[starts], minima[starts + w - size])
                values, members = tables[band]
                at = np.minimum(np.searchsorted(values, found), len(values) - 1)
                for k in np.flatnonzero(values[at] == found):
                    first = at[k]
                    while first < len(values) and values[first] == found[k]:
                        tries.add((int(members[first]), max(0, int(starts[k]) - window), int(starts[k]) + 2 * window))
                        first += 1
        best: list[dict[str, tuple[float, int, int]]] = [{} for _ in texts]
        for i, low, high in tries:
            first, last = np.searchsorted(offsets, [low, min(high, len(s)) - 1], "right") - 1
            for d in range(first, last + 1):
                a = max(low, offsets[d])
                near = s[a : min(high, offsets[d + 1])]
                hits = np.flatnonzero(np.isin(near, self.sets[i]))
                if not len(hits):
                    continue
                share = len(np.unique(near[hits])) / len(self.sets[i])
                place = int(a - offsets[d])
                found = (round(share, 4), -(place + int(hits[0])), place + int(hits[-1]) + WIDTH)
                if share >= self.least and found > best[d].get(self.names[i], (0.0, 0, 0)):
                    best[d][self.names[i]] = found
        return [sorted(((n, c, -a, e) for n, (c, a, e) in b.items()), key=lambda m: (m[2], m[0])) for b in best]


def _permuted(s: np.ndarray, band: int) -> np.ndarray:
    return (s ^ (s >> np.uint64(29)) ^ np.uint64(band)) * np.uint64(2 * (0x9E3779B97F4A7C15 * (band + 1) % (1 << 62)) + 1)


@lru_cache(maxsize=4)
def scanner(least: float, sure: float) -> Scanner:
    return Scanner(TEMPLATES, least, sure)


def scan_licenses(docs: DataFrame, least: float = 0.75, sure: float = 0.999) -> DataFrame:
    """Per row of (doc_id, text): n_licenses, their names, and name:containment:first word:end word of each."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(rows: dict) -> dict:
        found = scanner(least, sure).scan(rows["text"])
        return {
            "doc_id": rows["doc_id"], "n_licenses": [len(f) for f in found], "licenses": [",".join(sorted(m[0] for m in f)) for f in found],
            "places": [",".join(f"{n}:{c:.4f}:{a}:{b}" for n, c, a, b in f) for f in found],
        }

    return map_columns(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_licenses long, licenses string, places string")
