"""License scans by MinHash over overlapping text windows.

Words are runs of letters and digits, lower-cased in ASCII; five in a row make a shingle.  A template matches a text if
some window of ``SLACK`` times the template's number of shingles contains at least 80 % of the template's different
shingles.  Overlapping windows retrieve the templates with which they share a MinHash band: from the least Jaccard
similarity that such a window can have, each window size gets as many bands as make a miss less likely than ``MISS``.
Retrieved pairs are then verified by counting shingles exactly.

Defined results: texts without a match, null and empty texts give no row; a text gives one row for each template that
matches, with its best window (the first of equals); repeated rows repeat; very long texts are scanned whole; templates
of fewer than five words are one shingle; an empty table gives an empty table."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import for_python, tidy

SHINGLE, CONTAINED, SLACK = 5, 0.8, 1.25
#: Accepted probability that a matching window shares no band with its template.
MISS = 1e-5
#: Bytes of text, and shingles, processed at once.
SLICE, WINDOWS = 2 << 20, 1 << 19

#: Notices and texts of public licenses, fixed values.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]

_LOWER = np.zeros(256, dtype=np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _LOWER[_b] = _b
_LOWER[65:91] = np.arange(97, 123)
_ODD = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(4096, _ODD, dtype=np.uint64), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops and 64-bit hashes of the words in bytes."""
    lower = _LOWER[data]
    border = np.flatnonzero(np.diff(np.r_[False, lower != 0, False]))
    starts, stops = border[::2], border[1::2]
    if not len(starts):
        return starts, stops, np.zeros(0, dtype=np.uint64)
    inside = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.r_[starts, len(data)]))
    parts = lower[starts[0] :].astype(np.uint64) * _POWERS[inside & 4095]
    return starts, stops, _mixed(np.add.reduceat(parts, starts - starts[0]))


def shingled(hashes: np.ndarray) -> np.ndarray:
    """Hashes of each five words in a row (of all words, if there are fewer)."""
    n = min(SHINGLE, len(hashes))
    if not n:
        return hashes
    total = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        total = (total + hashes[k : k + len(total)]) * _ODD
    return _mixed(total)


def bands_for(similarity: float, rows: int = 1, miss: float = MISS) -> int:
    """Bands of so many rows that sets of this similarity share none with a probability of at most miss."""
    each = similarity**rows
    return 1 if each >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - each)))


class Templates:
    """Shingles of the templates, and their MinHash bands by window size."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, seed: int = 11):
        self.names = [name for name, _ in templates]
        self.shingles = [np.unique(shingled(words(np.frombuffer(t.encode(), dtype=np.uint8))[2])) for _, t in templates]
        self.windows = [max(1, math.ceil(SLACK * len(s))) for s in self.shingles]
        rng = np.random.default_rng(seed)
        self.multipliers = rng.integers(1, 1 << 32, size=(256, 2), dtype=np.uint32) | np.uint32(1)
        # Windows of similar size share a class.  Its step is a power of two, at most a quarter of its window.
        sizes: dict[int, list[int]] = {}
        for t, w in enumerate(self.windows):
            sizes.setdefault(w if w <= 8 else math.ceil(1.25 ** math.ceil(math.log(w, 1.25))), []).append(t)
        self.classes = []
        for size, members in sorted(sizes.items()):
            step = 1 << max(0, size // 4).bit_length() >> 1 if size >= 8 else 1
            span = size if step == 1 else -(-size // step) * step + step  # so some window covers any of this size
            least = 1.0
            for t in members:
                n = len(self.shingles[t])
                shared = math.ceil(CONTAINED * n)
                least = min(least, shared / (span + n - shared))
            bands = []
            for k in range(bands_for(least)):
                minima: dict[int, list[int]] = {}
                for t in members:
                    minima.setdefault(int(self._hashed(self.shingles[t], k).min()), []).append(t)
                bands.append(minima)
            self.classes.append((step, span, bands))
        self.top = max(step for step, _, _ in self.classes)

    def _hashed(self, shingles: np.ndarray, k: int) -> np.ndarray:
        """A permutation of 32 bits of the shingles' hashes; pairs that only share those are verified away."""
        return self._permuted((shingles >> np.uint64(32)).astype(np.uint32), k)

    def _permuted(self, short: np.ndarray, k: int) -> np.ndarray:
        """Two odd products with the high bits folded into the low ones between: a product alone keeps too much order."""
        x = short * self.multipliers[k, 0]
        x ^= x >> np.uint32(16)
        x *= self.multipliers[k, 1]
        x ^= x >> np.uint32(15)
        return x

    def retrieved(self, shingles: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first shingle, span) for windows that share a band.

        Minima of steps are halved from level to level, and a class takes those of its step."""
        found = set()
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        padded = np.full(-(-len(short) // self.top) * self.top, ~np.uint32(0), dtype=np.uint32)
        for k in range(max(len(bands) for _, _, bands in self.classes)):
            padded[: len(short)] = self._permuted(short, k)
            level, step = padded, 1
            for size, span, bands in self.classes:
                if k >= len(bands):
                    continue
                while step < size:
                    level, step = np.minimum(level[::2], level[1::2]), 2 * step
                reach = min(span // step, len(level))
                low, width = level, 1  # windows grow by doubling
                while 2 * width <= reach:
                    low, width = np.minimum(low[:-width], low[width:]), 2 * width
                if width < reach:
                    low = np.minimum(low[: len(level) - reach + 1], low[reach - width :][: len(level) - reach + 1])
                for value, members in bands[k].items():
                    for w in np.flatnonzero(low == np.uint32(value)).tolist():
                        found.update((t, w * step, span) for t in members)
        return found

    def best(self, template: int, shingles: np.ndarray) -> tuple[float, int, int]:
        """The largest containment of any window of shingles, and where its first and last template shingle are."""
        wanted, size = self.shingles[template], self.windows[template]
        places = np.flatnonzero(np.isin(shingles, wanted))
        top, low, counts = (0, 0, 0), 0, {}
        for high, p in enumerate(places):
            counts[shingles[p]] = counts.get(shingles[p], 0) + 1
            while places[low] <= p - size:
                left = shingles[places[low]]
                counts[left] -= 1
                if not counts[left]:
                    del counts[left]
                low += 1
            if len(counts) > top[0]:
                top = (len(counts), int(places[low]), int(p))
        return top[0] / len(wanted), top[1], top[2]

    def scan(self, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        """(template, containment, first word, first byte, end byte) of each template that matches."""
        shingles = shingled(hashes)
        if not len(shingles):
            return []
        found: dict[int, list[tuple[int, int]]] = {}
        over = max(span for _, span, _ in self.classes) + SHINGLE
        for at in range(0, len(shingles), WINDOWS):
            for t, first, span in self.retrieved(shingles[at : at + WINDOWS + over]):
                found.setdefault(t, []).append((at + first, at + first + span))
        out = []
        for t in sorted(found):
            top, reach = None, 0
            region: list[list[int]] = []
            for a, b in sorted(found[t]):
                a, b = max(0, a), min(len(shingles), b)
                if region and a <= region[-1][1]:
                    region[-1][1] = max(region[-1][1], b)
                else:
                    region.append([a, b])
            for a, b in region:
                share, p, q = self.best(t, shingles[a:b])
                if top is None or share > top[0]:
                    top = (share, a + p, a + q)
            if top and top[0] >= CONTAINED:
                last = min(len(stops) - 1, top[2] + SHINGLE - 1)
                out.append((t, top[0], top[1], int(starts[top[1]]), int(stops[last])))
        return out


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of one text of any length, a slice at a time, cut between words."""
    data = np.frombuffer(text, dtype=np.uint8)
    if len(data) <= SLICE:
        return words(data)
    parts, at = [], 0
    while at < len(data):
        stop = min(len(data), at + SLICE)
        while stop < len(data) and _LOWER[data[stop]]:
            stop += 1
        starts, stops, hashes = words(data[at:stop])
        parts.append((starts + at, stops + at, hashes))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*parts))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, template (its number), containment, first_word, first_byte, end_byte: a row for each match."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "license", "template", "containment", "first_word", "first_byte", "end_byte"]
    types = [pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def each(batches):
        index = Templates(templates)
        # Texts are joined for the hashing; a text's own shingles never reach into the next.
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            at, rows = [], []
            for k, found in enumerate(_scanned(index, texts)):
                at += [k] * len(found)
                rows += [(index.names[m[0]], *m) for m in found]
            columns = list(zip(*rows)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]], names)

    schema = f"doc_id {kind}, license string, template int, containment double, first_word long, first_byte long, end_byte long"
    return for_python(docs, F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(each), schema)


def _scanned(index: Templates, texts: pa.Array):
    """Matches of each text.  A slice of short texts is retrieved at once; only texts with a retrieved window are looked at again."""
    held, used = [], 0
    for k in range(len(texts)):
        text = texts[k].as_py() or b""
        if len(text) > SLICE // 4:
            yield from _together(index, held)
            held, used = [], 0
            yield index.scan(*words_of(text))
            continue
        held.append(text)
        used += len(text)
        if used >= SLICE:
            yield from _together(index, held)
            held, used = [], 0
    yield from _together(index, held)


def _together(index: Templates, texts: list[bytes]):
    if not texts:
        return
    places, _, hashes = words(np.frombuffer(b" ".join(texts), dtype=np.uint8))
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), places, side="right")
    looked = set()
    shingles = shingled(hashes)
    if len(shingles):
        for t, first, span in index.retrieved(shingles):
            last = min(len(owner) - 1, first + span + SHINGLE - 2)
            looked.update(range(int(owner[min(first, len(owner) - 1)]), int(owner[last]) + 1))
    counts = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), dtype=int)
    for k, text in enumerate(texts):
        # Shorter texts than a shingle have one of their own, which the joined words don't show.
        yield index.scan(*words(np.frombuffer(text, dtype=np.uint8))) if k in looked or 0 < counts[k] < SHINGLE else []
