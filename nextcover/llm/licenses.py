"""License notices in texts, by MinHash bands over overlapping windows.

Every template (the words of a license notice) is a set of shingles of five words. A text is
covered by overlapping windows as long as each template length, a quarter of it apart, so some
window lies within an eighth of a notice's place. Windows and templates that agree in one of
``BANDS`` bands of ``ROWS`` minimum hashes meet; a window that is off by an eighth still shares
more than three quarters of its shingles, and is found with probability above 0.999
(``recall``). Each template that a window retrieves is then verified exactly: the share of the
template's shingles that stand in the window and an eighth to both sides must reach
``CONTAINMENT``.

Templates are a parameter, a mapping of names to notices; they are a list of the caller's, not
data, and go to the workers whole. Minimum hashes of all windows come from one running minimum
per hash, so the work doesn't grow with their overlap; the hashes of one band are held at a time.

A place is one notice: of the shingles around the window, those that stand as far from one another
as in the template, give or take an eighth, so that notices right behind one another stay apart.
Where no such run reaches ``CONTAINMENT`` (a notice with its sentences in another order), the
place is all of them. Notices that have much text in common are found each; ``closest`` marks those
of which no other notice at the same place holds more.

Nulls: a null text is an empty one and has no notice; a null template is left out, one of fewer
than five words counts as one shingle of all its words. A notice found in overlapping windows is
reported once, at the place where most of its shingles stand; notices that repeat in a text are
reported each. Rows with a null doc_id and repeated rows are scanned like others.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nextcover.llm.common import lowered, shingles, slices, small_batches, span_hashes, texts_of, word_spans

SHINGLE = 5
BANDS = 12
ROWS = 2
CONTAINMENT = 0.8
U = np.uint64

#: fixed values: notices as their licenses' publishers ask for them
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at""",
    "MIT": "Released under the MIT License",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under a Creative Commons Attribution 4.0 International License",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0""",
    "Apache-2.0 whole header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
        OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    "MIT line": "Licensed under the MIT License",
    "MIT whole text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
        OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
        DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
        CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
        DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
        CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means.""",
    "GPL-2.0 header": """This program is free software; you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-2.1 header": """This library is free software; you can redistribute it and/or modify it under the terms of the
        GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the
        License, or (at your option) any later version.""",
    "LGPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU Affero General Public License for more details.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
        the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public
        License 2.0 which is available at""",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0",
    "CC-BY-SA-4.0": "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0 notice": "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC0-1.0": """To the extent possible under law, the author has waived all copyright and related or neighboring rights
        to this work""",
}

_rng = np.random.default_rng(77)
FACTORS = _rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
ADDS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def recall(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Probability that two sets of this Jaccard similarity meet in a band."""
    return 1 - (1 - similarity ** rows) ** bands


def hashes(values: np.ndarray, i: int) -> np.ndarray:
    low = (values >> U(32)).astype(np.uint32) ^ (values & U(0xFFFFFFFF)).astype(np.uint32)
    low = low * FACTORS[i] + ADDS[i]
    low ^= low >> np.uint32(15)
    return low * np.uint32(0x2C1B3C6D)


class RunningMinima:
    """Minimum of every ``n`` values in a row, for any ``n``: by doubling, and the doubles are kept."""

    def __init__(self, values: np.ndarray):
        self.doubles = [values]

    def at(self, starts: np.ndarray, n: int) -> np.ndarray:
        k = n.bit_length() - 1
        while len(self.doubles) <= k:
            last, have = self.doubles[-1], 1 << len(self.doubles) - 1
            self.doubles.append(np.minimum(last[:-have], last[have:]))
        return np.minimum(self.doubles[k][starts], self.doubles[k][starts + n - (1 << k)])


def hashed_shingles(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Shingles, their rows and first words; start and end of every word in its text; the last word
    of each row."""
    data, offsets, _ = lowered(texts)
    starts, ends, row = word_spans(data, offsets)
    h, at, first = shingles(span_hashes(data, starts, ends), row, len(texts), SHINGLE)
    return h, at, first, starts - offsets[row], ends - offsets[row], np.searchsorted(row, np.arange(len(texts)), "right") - 1


class Templates:
    """Shingle sets by number of shingles, and a sorted table of their bands."""

    def __init__(self, notices: Mapping[str, str | None]):
        names = [n for n, t in notices.items() if t]
        h, at, *_ = hashed_shingles(pa.array([notices[n] for n in names], pa.string()))
        kept = [i for i in range(len(names)) if (at == i).any()]
        self.names = [names[i] for i in kept]
        self.sets = [np.unique(h[at == i]) for i in kept]
        #: of each template: its different shingles in order, as often as they stand, and their places
        self.places = []
        for i in kept:
            own = h[at == i]
            order = np.argsort(own, kind="stable")
            self.places.append((own[order], order, len(np.unique(own))))
        self.lengths: dict[int, list[int]] = {}
        for place, i in enumerate(kept):
            self.lengths.setdefault(int((at == i).sum()), []).append(place)
        self.bands: dict[int, list[np.ndarray]] = {}
        self.orders: dict[int, list[np.ndarray]] = {}
        for n, members in self.lengths.items():
            least = np.array([[hashes(self.sets[i], k).min() for i in members] for k in range(BANDS * ROWS)], np.uint32)
            keys = [band_keys(least[b * ROWS:(b + 1) * ROWS]) for b in range(BANDS)]
            self.orders[n] = [np.argsort(k, kind="stable") for k in keys]
            self.bands[n] = [k[o] for k, o in zip(keys, self.orders[n])]


def band_keys(minima) -> np.ndarray:
    key = np.zeros(len(minima[0]), U)
    for m in minima:
        key = key * U(0x9E3779B97F4A7C15) + m.astype(U)
    return key


def windows(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows of ``n`` shingles a quarter apart, the last one at each row's end; and the
    rows a little shorter than that, which are a window as a whole."""
    size = np.diff(first)
    step = max(1, n // 4)
    long_ = np.flatnonzero(size >= n)
    number = (size[long_] - n + step - 1) // step + 1
    place = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    starts = np.minimum(np.repeat(first[long_], number) + place * step, np.repeat(first[long_ + 1] - n, number))
    return starts, np.flatnonzero((size < n) & (size >= CONTAINMENT * n))


def place_of(inside: np.ndarray, h: np.ndarray, template: "Templates", t: int, n: int) -> tuple[int, int, float]:
    """First and last shingle of one notice among those (``inside``, ascending) that the template
    has, and the share of the template's shingles in between: the run of an eighth of ``n`` in
    distances from the template's own places that holds most."""
    known, order, size = template.places[t]
    lo, hi = np.searchsorted(known, h[inside], "left"), np.searchsorted(known, h[inside], "right")
    which = np.repeat(np.arange(len(inside)), hi - lo)
    own = order[np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
    shift = inside[which] - own
    by = np.argsort(shift, kind="stable")
    shift, which = shift[by], which[by]
    value = np.searchsorted(known, h[inside])[which]
    best, count, a = (0, 0, 0), np.zeros(len(known), int), 0
    different = 0
    for b in range(len(shift)):
        different += count[value[b]] == 0
        count[value[b]] += 1
        while shift[b] - shift[a] > n // 8:
            count[value[a]] -= 1
            different -= count[value[a]] == 0
            a += 1
        if different > best[0]:
            best = (different, a, b + 1)
    members = inside[which[best[1]:best[2]]]
    return int(members.min()), int(members.max()), best[0] / size


def scan(h: np.ndarray, at: np.ndarray, rows: int, templates: Templates) -> list[tuple[int, int, int, int, float]]:
    """(row, template, first shingle, last shingle, containment) of all notices among the shingles
    of several texts."""
    if not len(h):
        return []
    first = np.searchsorted(at, np.arange(rows + 1))
    spans = {n: windows(first, n) for n in templates.lengths}
    hits: dict[int, list[np.ndarray]] = {n: [] for n in spans}
    for b in range(BANDS):
        values = [hashes(h, k) for k in range(b * ROWS, (b + 1) * ROWS)]
        minima = [RunningMinima(v) for v in values]
        for n, (starts, short) in spans.items():
            # up to the next row's start; the pieces between two such rows are thrown away
            cuts = np.stack([first[short], first[short + 1]], 1).ravel()
            part = [np.minimum.reduceat(np.append(v, np.uint32(0xFFFFFFFF)), cuts)[::2] if len(short) else np.empty(0, np.uint32) for v in values]
            key = band_keys([np.append(m.at(starts, n), p) for m, p in zip(minima, part)])
            table, order = templates.bands[n][b], templates.orders[n][b]
            lo, hi = np.searchsorted(table, key, "left"), np.searchsorted(table, key, "right")
            some = np.flatnonzero(hi > lo)
            hits[n] += [np.array([(templates.lengths[n][order[j]], w) for w in some for j in range(lo[w], hi[w])], np.int64).reshape(-1, 2)]
    found: dict[tuple[int, int], list[tuple[int, int, float, float]]] = {}
    for n, (starts, short) in spans.items():
        begins, ends = np.append(starts, first[short]), np.append(starts + n, first[short + 1])
        for t, w in np.unique(np.concatenate(hits[n]), axis=0):
            row, reach = int(at[begins[w]]), n // 8 + (n > 1)
            a, b = max(int(first[row]), int(begins[w]) - reach), min(int(first[row + 1]), int(ends[w]) + reach)
            inside = np.flatnonzero(np.isin(h[a:b], templates.sets[t]))
            share = len(np.unique(h[a:b][inside])) / len(templates.sets[t])
            if share >= CONTAINMENT:
                x, y, one = place_of(inside, h[a:b], templates, int(t), n)
                if one < CONTAINMENT:
                    x, y = int(inside[0]), int(inside[-1])
                found.setdefault((row, int(t)), []).append((a + x, a + y, one if one >= CONTAINMENT else share, one))
    out = []
    for (row, t), places in found.items():
        # places of one notice first, fullest first; what overlaps a place taken is the same notice
        taken: list[tuple[int, int]] = []
        for a, b, share, _ in sorted(places, key=lambda p: (-p[3], p[1] - p[0], p[0])):
            i = bisect.bisect_left(taken, (a, b))
            if (i == len(taken) or taken[i][0] > b) and (i == 0 or taken[i - 1][1] < a):
                taken.insert(i, (a, b))
                out.append((row, t, a, b, share))
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


def closest(places: list[tuple[int, int, int, int, float]]) -> list[bool]:
    """Of places sorted by row and first shingle: whether no overlapping one holds more of its notice."""
    best = [True] * len(places)
    for i, (row, _, _, b, share) in enumerate(places):
        for j in range(i + 1, len(places)):
            if places[j][0] != row or places[j][2] > b:
                break
            if places[j][4] != share:
                best[j if places[j][4] < share else i] = False
    return best


def license_scan(docs: DataFrame, notices: Mapping[str, str | None] = NOTICES) -> DataFrame:
    """(doc_id, license, start, stop, containment, closest): every notice, with the UTF-8 bytes of the
    text from its first to its last word."""
    small_batches(docs.sparkSession)
    templates = Templates(notices)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch["doc_id"].to_pylist(), []
            for lo, hi in slices(batch["text"]):
                h, at, word, starts, ends, last = hashed_shingles(batch["text"].slice(lo, hi - lo))
                places = scan(h, at, hi - lo, templates)
                out += [(ids[lo + row], templates.names[t], int(starts[word[a]]), int(ends[min(word[b] + SHINGLE - 1, last[row])]), share, best)
                        for (row, t, a, b, share), best in zip(places, closest(places))]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)],
                                             ["doc_id", "license", "start", "stop", "containment", "closest"])

    return texts_of(docs).mapInArrow(find, "doc_id long, license string, start long, stop long, containment double, closest boolean")
