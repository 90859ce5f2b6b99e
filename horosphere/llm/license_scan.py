"""License scan: MinHash bands over word windows, then exact shingle containment.

Every window of WINDOW words of a document is a set of word pairs with HASHES
minima, cut into bands of ROWS minima. The windows of the license templates are
indexed the same way (a small constant table every task holds). Settings:
windows of Jaccard similarity s meet with probability 1 - (1 - s**ROWS)**BANDS, equal
ones always. That is enough: a changed word breaks SHINGLE shingles, so a
stretch that holds CONTAINED of a template's shingles has unchanged windows.
Around each meeting the share of the template's distinct SHINGLE-word shingles
inside the aligned stretch of the document is counted exactly and must reach
CONTAINED. Where no single alignment does, those of a template that lie at most
its length apart are joined, so words inserted into a license do not hide it.

A scan needs no shuffle: each row is read once and judged where it is read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.llm.shingles import NOT_ALNUM, mix, runs, shingle_hashes, utf8, words

WINDOW, ROWS, BANDS = 4, 4, 4
HASHES = ROWS * BANDS
SHINGLE = 3
CONTAINED = 0.8
_U = np.uint64
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | _U(1)

# Public license statements and notices, as (license, text).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
     "Unless required by applicable law or agreed to in writing, software distributed under the License is "
     'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See '
     "the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     'associated documentation files (the "Software"), to deal in the Software without restriction, including '
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
     "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
     "conditions: The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
     "or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met: Redistributions of source code must retain the above copyright "
     "notice, this list of conditions and the following disclaimer."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
     "General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
     "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
     "held liable for any damages arising from the use of this software."),
]


def _hash(texts):
    raw, off = utf8(pa.array(texts, pa.large_string()))
    h, begin, end, first = words(raw, off, NOT_ALNUM)
    return h, first


def _pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] + h[1:] * _U(0x9E3779B97F4A7C15))


def _bands(h: np.ndarray):
    """Yield for each band the key of the window that begins at each word."""
    p = _pairs(h)
    n = len(p) - (WINDOW - 2)
    if n <= 0:
        return
    for band in range(BANDS):
        key = np.full(n, _U(band + 1))
        for r in range(ROWS):
            v = p * _SEEDS[band * ROWS + r]
            low = v[:n].copy()
            for j in range(1, WINDOW - 1):
                np.minimum(low, v[j:n + j], out=low)
            key += low * _SEEDS[r] + (low >> _U(32))
        yield mix(key)


class Index:
    """Band keys of all template windows, sorted, with a bit table before them."""

    def __init__(self, templates=None):
        self.templates = templates or TEMPLATES
        h, first = _hash([t for _, t in self.templates])
        self.words = [h[first[i]:first[i + 1]] for i in range(len(self.templates))]
        self.shingles = [np.unique(shingle_hashes(w, np.array([0, len(w)]), SHINGLE)[0]) for w in self.words]
        keys, who, at = [], [], []
        for i, w in enumerate(self.words):
            for key in _bands(w):
                keys.append(key)
                who.append(np.full(len(key), i))
                at.append(np.arange(len(key)))
        keys, who, at = map(np.concatenate, (keys, who, at))
        order = np.argsort(keys, kind="stable")
        self.keys, self.who, self.at = keys[order], who[order], at[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys >> _U(44)).astype(np.int64)] = True

    def candidates(self, h: np.ndarray, first: np.ndarray):
        """Distinct (row, template, first word of the template's place in the row)."""
        got = set()
        row_end = first[1:]
        for key in _bands(h):
            hit = np.flatnonzero(self.bits[(key >> _U(44)).astype(np.int64)])
            if not len(hit):
                continue
            lo, hi = (np.searchsorted(self.keys, key[hit], s) for s in ("left", "right"))
            for j in np.flatnonzero(hi > lo):
                row = int(np.searchsorted(row_end, hit[j], "right"))
                if hit[j] + WINDOW <= row_end[row]:
                    got.update((row, int(t), int(hit[j] - first[row] - a))
                               for t, a in zip(self.who[lo[j]:hi[j]], self.at[lo[j]:hi[j]]))
        return got

    def contained(self, t: int, doc: np.ndarray, start: int, last: int | None = None):
        """Share of template t's shingles in the stretch laid at ``start``, or from there to the one at ``last``."""
        n = len(self.words[t])
        slack = n // 8 + 1
        a, z = max(0, start - slack), min(len(doc), (start if last is None else last) + n + slack)
        s, _ = shingle_hashes(doc[a:z], np.array([0, z - a]), SHINGLE)
        return float(np.isin(self.shingles[t], s).mean()) if len(s) else 0.0


    def places(self, t: int, doc: np.ndarray, starts: list[int]):
        """(share, start) of every alignment of template t that reaches CONTAINED, alone or joined with
        the next ones; ``starts`` ascend."""
        n = len(self.words[t])
        share = [self.contained(t, doc, s) for s in starts]
        out = [(x, s) for x, s in zip(share, starts) if x >= CONTAINED]
        alone = [s for _, s in out]
        for i, s in enumerate(starts):
            last = bisect_right(starts, s + n) - 1
            j = bisect_left(alone, s - n)
            if last > i and not (j < len(alone) and alone[j] <= s + n):
                x = self.contained(t, doc, s, starts[last])
                if x >= CONTAINED:
                    out.append((x, s))
        return out


def _scan(templates):
    def run(batches):
        index = Index(templates)
        names = ["doc_id", "license_id", "containment", "template_words", "word_pos"]
        for b in batches:
            raw, off = utf8(b.column(1))
            ids = b.column(0).to_pylist()
            out = []
            for lo, hi in runs(off):
                o = off[lo:hi + 1]
                h, _, _, first = words(raw[o[0]:o[-1]], o - o[0], NOT_ALNUM)
                best: dict = {}
                for (row, t), group in groupby(sorted(index.candidates(h, first)), key=lambda c: c[:2]):
                    for share, start in index.places(t, h[first[row]:first[row + 1]], [c[2] for c in group]):
                        k = (row, index.templates[t][0])
                        best[k] = max(best.get(k, (0.0, 0, 0)), (share, len(index.words[t]), -max(0, start)))
                out += [(ids[lo + r], lic, s, n, -p) for (r, lic), (s, n, p) in best.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(
                    zip(*out), (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()))], names)
    return run


def license_scan(docs: DataFrame, templates=None) -> DataFrame:
    """One row per (document row, license) found: doc_id, license_id, containment
    (share of the best template's shingles), template_words and word_pos (first
    word of that place).

    Words are runs of letters and digits, ASCII case ignored. Null and empty
    texts hold no license; null doc_ids are returned as they are; repeated rows
    are judged one by one; other columns are ignored; an empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(_scan(templates), "doc_id long, license_id string, containment double, template_words long, word_pos long")
