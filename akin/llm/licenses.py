"""License texts inside documents: MinHash bands over text windows, then exact containment.

A template is the set of its shingles of three words. Windows of a template, at every
offset, are entered by MinHash bands; the windows of a document, at overlapping offsets, look
them up. Window lengths come from a short list of scales: a template uses the largest
``w`` with ``w + stride - 1`` shingles or less, so an unchanged copy of it always holds a
document window that equals a template window, which collides for certain; a window of
Jaccard similarity ``j`` collides with probability ``1 - (1 - j^rows)^bands``
(:func:`collision_probability`, 0.9997 at 0.8 by default). Around the places that were retrieved
every stretch of up to ``spread`` times the template's length is verified exactly: the share of
the template's shingles that it holds. So words may be changed, cut out or put in, a sentence
in the middle as well.

Scale: documents are scanned once, nothing is shuffled. The templates' size is checked
(``MAX_SHINGLES``) before they are broadcast; a longer list can be scanned in parts. Verifying
takes time in proportion to the shingles found, however often a text repeats a notice.

Cases: null and empty texts, and texts of fewer than three words, have no match. Words are
runs of ASCII letters, digits and non-ASCII characters, in lower case. Of overlapping matches
of one template the best counts (then the shortest, then the first); beside it others are looked
for. Every occurrence is a row; a row is judged by itself, so repeated rows and ids repeat their
matches, and a null id stays null. Only id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import ALNUM_HIGH, chunks, mix, rolling, starts_inside, words_of

SHINGLE, BANDS, ROWS, CONTAINMENT, MAX_SHINGLES = 3, 8, 2, 0.8, 1_000_000
#: A match's longest stretch of shingles, as a multiple of its template's.
SPREAD = 2.0
#: Window lengths in shingles, with the distance of a document's windows.
SCALES = ((1, 1), (3, 1), (6, 1), (12, 3), (24, 6))

# Notices as their licenses give them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit-line": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
}


def collision_probability(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Chance that two windows of this Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """Smallest value of each run of ``w``, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def _bands(shingles: np.ndarray, scales: list[int], bands: int, rows: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(scale, band, keys)``, a key for the window at each shingle."""
    odd = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    for band in range(bands):
        turned = [shingles * odd[band * rows + r] for r in range(rows)]
        for w in scales:
            if len(shingles) >= w:
                key = np.full(len(shingles) - w + 1, np.uint64(band * 1000 + w))
                for t in turned:
                    key = key * np.uint64(0x9E3779B97F4A7C15) + _least(t, w)
                yield w, band, key * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    def __init__(self, templates: dict[str, str], bands: int = BANDS, rows: int = ROWS):
        self.names, self.bands, self.rows = list(templates), bands, rows
        words = words_of([t.encode() for t in templates.values()], ALNUM_HIGH, lower=True)
        shingles, inside = rolling(words.hash, SHINGLE), starts_inside(words, SHINGLE)
        self.sets, self.lengths, found = [], [], []
        for i in range(len(self.names)):
            a, b = words.first[i], max(words.first[i], words.first[i + 1] - SHINGLE + 1)
            if b == a:
                raise ValueError(f"template {self.names[i]} has fewer than {SHINGLE} words")
            own = shingles[a:b]
            assert inside[a:b].all()
            self.sets.append(np.unique(own))
            self.lengths.append(len(own))
            w = max(w for w, stride in SCALES if w + stride - 1 <= len(own))
            for _, band, keys in _bands(own, [w], bands, rows):
                found += [(int(k), i, at) for at, k in enumerate(keys)]
        if sum(self.lengths) > MAX_SHINGLES:
            raise ValueError("too many template shingles for one scan: scan the templates in parts")
        found.sort()
        self.keys = np.array([k for k, _, _ in found], np.uint64)
        self.where = np.array([(i, at) for _, i, at in found], np.int64)
        self.sieve = np.zeros(1 << 18, bool)
        self.sieve[(self.keys >> np.uint64(46)).astype(np.int64)] = True
        used = {max(w for w, stride in SCALES if w + stride - 1 <= n) for n in self.lengths}
        self.scales = [w for w, _ in SCALES if w in used]

    def matches(self, texts: list[bytes], least: float, spread: float = SPREAD) -> list[list[tuple[int, int, int, float]]]:
        """By text: ``(template, first word, end word, containment)``."""
        words = words_of(texts, ALNUM_HIGH, lower=True)
        shingles = rolling(words.hash, SHINGLE)
        local = np.arange(len(shingles)) - words.first[words.doc[: len(shingles)]]
        places = [np.zeros((0, 2), np.int64)]
        for w, _, keys in _bands(shingles, self.scales, self.bands, self.rows):
            at = np.flatnonzero(self.sieve[(keys >> np.uint64(46)).astype(np.int64)])
            at = at[(local[at] % dict(SCALES)[w] == 0) & (words.doc[at] == words.doc[at + w + SHINGLE - 2])]
            left, right = np.searchsorted(self.keys, keys[at], "left"), np.searchsorted(self.keys, keys[at], "right")
            n = right - left
            entry = np.repeat(left - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            places.append(np.stack([self.where[entry, 0], np.repeat(at, n)], 1))
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        found = np.unique(np.concatenate(places), axis=0)
        for template in np.unique(found[:, 0]).tolist():
            own, at = self.sets[template], found[found[:, 0] == template, 1]
            width = int(np.ceil(spread * self.lengths[template]))
            doc = words.doc[at]
            begin, end = np.maximum(at - width + 1, words.first[doc]), np.minimum(at + width, np.maximum(words.first[doc + 1] - SHINGLE + 1, words.first[doc]))
            new = np.flatnonzero(np.r_[True, (begin[1:] > np.maximum.accumulate(end)[:-1]) | (doc[1:] != doc[:-1])])
            for a, b, d in zip(begin[new].tolist(), np.maximum.reduceat(end, new).tolist(), doc[new].tolist(), strict=True):
                which = np.minimum(np.searchsorted(own, shingles[a:b]), len(own) - 1)
                held = np.flatnonzero(own[which] == shingles[a:b])
                base = a - int(words.first[d])
                for first, last, share in stretches(held.tolist(), which[held].tolist(), width, least, len(own)):
                    out[d].append((template, base + first, base + last + SHINGLE, share))
        return [sorted(x) for x in out]


def stretches(at: list[int], which: list[int], width: int, least: float, total: int) -> list[tuple[int, int, float]]:
    """Stretches ``(first, last, share)`` of at most ``width`` places that hold ``least`` of ``total`` kinds.

    ``at``: places of things in order, ``which``: their kinds. The best stretch counts (of most
    kinds, then the shortest, then the first), then the best that doesn't overlap it, and so on;
    what then lies between them is searched again.
    """
    need = max(1, int(np.ceil(least * total - 1e-9)))
    kept: list[tuple[int, int, float]] = []
    todo = [(0, len(at))]
    while todo:
        a, b = todo.pop()
        if b - a < need:
            continue
        own: list[tuple[int, int]] = []  # indexes of first and last, ascending and apart
        for kinds, _, i, j in sorted(_candidates(at[a:b], which[a:b], width, need)):
            i, j = i + a, j + a
            k = bisect_left(own, (i, j))
            if (k == 0 or own[k - 1][1] < i) and (k == len(own) or j < own[k][0]):
                own.insert(k, (i, j))
                kept.append((at[i], at[j], -kinds / total))
        if own:
            todo += zip([a, *(j + 1 for _, j in own)], [*(i for i, _ in own), b], strict=True)
    return kept


def _candidates(at: list[int], which: list[int], width: int, need: int) -> Iterator[tuple[int, int, int, int]]:
    """From each place on: minus the kinds within ``width``, the length that has them all, and the indexes of its ends."""
    after, seen = [0] * len(at), {}
    for i in range(len(at) - 1, -1, -1):
        after[i] = seen.get(which[i], -1)
        seen[which[i]] = i
    count: dict[int, int] = {}
    firsts: list[int] = []  # where each kind within reach comes first, the last of these on top
    kinds = right = 0
    for i, place in enumerate(at):
        while right < len(at) and at[right] < place + width:
            n = count.get(which[right], 0)
            if not n:
                kinds += 1
                heapq.heappush(firsts, -right)
            count[which[right]] = n + 1
            right += 1
        if kinds >= need:
            last = -firsts[0]
            yield -kinds, at[last] - place, i, last
        count[which[i]] -= 1
        if count[which[i]]:
            heapq.heappush(firsts, -after[i])
        else:
            kinds -= 1


def scan(
    df: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT, bands: int = BANDS, rows: int = ROWS,
    spread: float = SPREAD,
) -> DataFrame:
    """``(id, license_id, start_word, end_word, containment)``, a row for each verified match."""
    shared = df.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES, bands, rows))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for _, texts, part in chunks(batches):
            rows = [(i, index.names[t], a, b, c) for i, found in enumerate(index.matches(texts, containment, spread)) for t, a, b, c in found]
            take = pa.array([r[0] for r in rows], pa.int64())
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), *columns], ["id", "license_id", "start_word", "end_word", "containment"])

    schema = f"id {kind}, license_id string, start_word long, end_word long, containment double"
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
