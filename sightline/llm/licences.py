"""Licence scan: MinHash bands over overlapping windows of a text retrieve templates, exact containment confirms them.

Shingles are five words (lower case, ASCII punctuation as space); a template of fewer words is one shingle of all of
them. Windows are three adjacent blocks, taken at every block, whose size fits the template's so that a run as long as
the template lies whole in some window. A window that holds 0.8 of a template then has a Jaccard similarity of a third or
more with it; with one register a band and 40 bands it shares a band with probability 1 - (2/3) ** 40 = 1 - 9e-8.
A template is found where a window holds at least LEAST of its distinct shingles. Its spans there begin and end with a
shingle of the template. Those that begin with its first and end with its last come first, then those that have more of the
template for their length, then the earliest, and each span that is disjoint from those before it is a match of its own.

Defined cases: a null or empty text has no matches; equal texts get equal matches; a notice that a text holds several
times, side by side or apart, gives a match each; matches are in order of template and place; further columns are left
alone.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from sightline.llm import ragged
from sightline.llm.near import _FOLD, SHINGLE

LEAST, BANDS = 0.8, 40
MATCHES = "licences array<struct<name:string,start:int,end:int,containment:double>>"

# Notices as their licences prescribe them, and short statements in common use.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mit-short": "Released under the MIT License.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_ODD = np.random.default_rng(40).integers(0, 1 << 62, BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = ragged.buffer_of(pc.utf8_lower(pc.fill_null(column, "")))
    data = _FOLD[data]
    starts, ends, rows = ragged.words(data, offs)
    return ragged.span_hashes(data, starts, ends), rows


#: (rough, -fit, start, end, share): how many ends aren't the template's own, and common shingles to all of both.
Match = tuple[int, float, int, int, float]


def spans(code: np.ndarray, width: int, head: int, tail: int) -> list[Match]:
    """Disjoint matches of a window, start and end as its first and last shingle, best first.

    code is each shingle's number among the template's width distinct ones, or -1; head and tail are the template's ends.
    """
    place = np.flatnonzero(code >= 0)
    code = code[place]
    n = len(code)
    order = np.argsort(code, kind="stable")
    again = code[order][1:] == code[order][:-1]
    before, after = np.full(n, -1), np.full(n, n)
    before[order[1:][again]] = order[:-1][again]
    after[order[:-1][again]] = order[1:][again]
    k = np.arange(n)
    new = (before[None, :] < k[:, None]) & (k[None, :] >= k[:, None])
    share = np.cumsum(new, axis=1) / width
    # an end that isn't the template's own has to be held once, else the span is longer than need be
    tight = ((after[:, None] > k[None, :]) | (code == head)[:, None]) & (new | (code == tail)[None, :])
    first, last = np.nonzero(tight & (k[None, :] >= k[:, None]) & (share >= LEAST - 1e-12))
    size, share = place[last] - place[first] + 1, share[first, last]
    rough = (code[first] != head).astype(int) + (code[last] != tail)
    fit = share * width / (width + size - share * width)
    rank = np.lexsort((first, -fit, rough))
    out = []
    while len(rank):
        best = rank[0]
        out.append((int(rough[best]), -float(fit[best]), int(place[first[best]]), int(place[last[best]]), float(share[best])))
        rank = rank[(last[rank] < first[best]) | (first[rank] > last[best])]
    return out


def disjoint(matches: set[Match]) -> list[Match]:
    """The matches that overlap no better one, by place."""
    starts: list[int] = []
    kept: list[Match] = []
    for m in sorted(matches):
        i = bisect.bisect_left(starts, m[2])
        if (i == 0 or kept[i - 1][3] <= m[2]) and (i == len(kept) or m[3] <= starts[i]):
            starts.insert(i, m[2])
            kept.insert(i, m)
    return kept


class Templates:
    """The templates by shingle size and block size, with their registers."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.names = sorted(texts)
        h, rows = word_hashes(pa.array([texts[n] for n in self.names]))
        self.sets: list[np.ndarray] = []
        self.ends: list[tuple[int, int]] = []
        self.groups: dict[int, dict[int, list[int]]] = {}
        for i in range(len(self.names)):
            own = h[rows[i] : rows[i + 1]]
            size = min(SHINGLE, len(own))
            if not size:
                raise ValueError(f"template {self.names[i]!r} has no words")
            g, _ = ragged.grams(own, np.array([0, len(own)]), size)
            self.sets.append(np.unique(g))
            self.ends.append(tuple(np.searchsorted(self.sets[-1], g[[0, -1]])))
            block = max(1, round(2 ** (np.ceil(2 * np.log2(len(g))) / 2) / 2 + 0.49))
            self.groups.setdefault(size, {}).setdefault(block, []).append(i)

    def scan(self, column: pa.Array) -> dict[int, list[tuple[str, int, int, float]]]:
        """Matches by row."""
        h, rows = word_hashes(column)
        out: dict[int, dict[int, set[Match]]] = {}
        for size, blocks in self.groups.items():
            g, at = ragged.grams(h, rows, size)
            if not len(g):
                continue
            found: dict[int, set[tuple[int, int]]] = {t: set() for ts in blocks.values() for t in ts}
            cuts = {}
            for block in blocks:
                counts = -(-np.diff(at) // block)
                to = np.concatenate([[0], np.cumsum(counts)])
                begin = np.repeat(at[:-1], counts) + block * (np.arange(to[-1]) - np.repeat(to[:-1], counts))
                cuts[block] = begin, ragged.owner(to), to
            for k in range(BANDS):
                x = g * _ODD[k]
                for block, members in blocks.items():
                    begin, own, to = cuts[block]
                    low = np.minimum.reduceat(x, begin)
                    two = low.copy()
                    for step in (1, 2):
                        same = own[step:] == own[:-step]
                        two[:-step] = np.where(same, np.minimum(two[:-step], low[step:]), two[:-step])
                    for t in members:
                        for b in np.flatnonzero(two == (self.sets[t] * _ODD[k]).min()):
                            found[t].add((block, int(b)))
            for t, windows in found.items():
                own_set = self.sets[t]
                for block, b in windows:
                    begin, own, _ = cuts[block]
                    row = int(own[b])
                    lo, hi = int(begin[b]), min(int(begin[b]) + 3 * block, int(at[row + 1]))
                    place = np.minimum(np.searchsorted(own_set, g[lo:hi]), len(own_set) - 1)
                    code = np.where(own_set[place] == g[lo:hi], place, -1)
                    if len(np.unique(code[code >= 0])) >= (LEAST - 1e-12) * len(own_set):
                        lo -= int(at[row])
                        out.setdefault(row, {}).setdefault(t, set()).update((r, f, lo + s, lo + e + size, c) for r, f, s, e, c in spans(code, len(own_set), *self.ends[t]))
        return {r: [(self.names[t], s, e, c) for t, matches in sorted(m.items()) for _, _, s, e, c in disjoint(matches)] for r, m in out.items()}


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """docs with the column licences: name, word span and containment of each template found."""
    texts = templates or TEMPLATES
    source = docs.select([c for c in docs.columns if c != "licences"])
    schema = StructType(source.schema.fields + StructType.fromDDL(MATCHES).fields)
    kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Templates(texts)
        for b in ragged.chunks(batches, "text", 1 << 20):
            found = own.scan(b["text"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[dict(zip(("name", "start", "end", "containment"), m, strict=True)) for m in found.get(i, [])] for i in range(b.num_rows)], kind)], schema.names)

    return ragged.map_batches(source, work, schema)
