"""Licence scans: Dice coefficient over word bigrams against licence templates.

A text's lines, its paragraphs and the whole of it are normalised to lower-case
words of letters and digits, and compared as sets of word pairs with each
template whose size allows the wanted coefficient at all. Windows of a
template's number of words, anywhere in the text, are compared as well, and
count where no matching segment lies.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm import scratch

#: Least Dice coefficient of a match.
LEAST = 0.8

#: Licence notices as they are published (fixed values).
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
]

_MIT, _ISC = (next(t for n, t in TEMPLATES if n == name and t.startswith("Permission")) for name in ("MIT", "ISC"))
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
TEMPLATES += [
    ("MIT", f"{_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    (
        "ISC",
        f"{_ISC} THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
]

# Families of licences that differ in a version or in elements alone have templates for each of these, so
# that the nearest template of a notice is that of its own version and elements (fixed values).
_GNU = {"": ("GPL", ("1", "2", "3")), "Lesser ": ("LGPL", ("2.1", "3")), "Library ": ("LGPL", ("2",)), "Affero ": ("AGPL", ("1", "3"))}
_CC = {"": "", "SA": "-ShareAlike", "NC": "-NonCommercial", "ND": "-NoDerivatives", "NC-SA": "-NonCommercial-ShareAlike", "NC-ND": "-NonCommercial-NoDerivatives"}
_CC_VERSIONS = {"2.0": " Generic", "2.5": " Generic", "3.0": " Unported", "4.0": " International"}
_VERSIONED = {"Apache": ("Apache License", ("1.1", "2.0")), "MPL": ("Mozilla Public License", ("1.1", "2.0")), "EPL": ("Eclipse Public License", ("1.0", "2.0")), "BSL": ("Boost Software License", ("1.0",))}


def _families() -> Iterator[tuple[str, str]]:
    for kind, (short, versions) in _GNU.items():
        for v in versions:
            name = f"{short}-{v if '.' in v else v + '.0'}"
            yield name, f"This work is licensed under the GNU {kind}General Public License, version {v}."
            yield name, f"Licensed under the GNU {kind}General Public License v{v if '.' in v else v + '.0'}."
            yield name, (
                f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by "
                f"the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
            )
    for elements, words in _CC.items():
        for v, place in _CC_VERSIONS.items():
            short = f"BY-{elements}" if elements else "BY"
            yield f"CC-{short}-{v}", f"Licensed under CC {short} {v}."
            yield f"CC-{short}-{v}", f"This work is licensed under a Creative Commons Attribution{words} {v}{place} License."
    for short, (long, versions) in _VERSIONED.items():
        for v in versions:
            yield f"{short}-{v}", f"Licensed under the {long}, Version {v}."
            yield f"{short}-{v}", f"This project is licensed under the {long}, Version {v}."


#: Bodies of short licences, as they are published (fixed values).
_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES += [
    ("BSD-2-Clause", f"{_CONDITIONS} {_TWO} {_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_CONDITIONS} {_TWO} {_THIRD} {_DISCLAIMER}"),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
]
TEMPLATES += [x for x in dict.fromkeys(_families()) if x not in TEMPLATES]

_WORD = re.compile(rb"[a-z0-9]+")


def pairs(raw: bytes) -> set[bytes]:
    """Adjacent words of a normalised text, two by two."""
    words = _WORD.findall(raw.lower())
    return {b"%b %b" % p for p in zip(words, words[1:])}


class Templates:
    """Templates by size, and which of them hold a word pair."""

    def __init__(self, templates: list[tuple[str, str]], least: float):
        self.least = least
        made = sorted(((len(p := pairs(text.encode())), name, p) for name, text in templates), key=lambda x: x[:2])
        self.sizes, self.names = [n for n, _, _ in made], [name for _, name, _ in made]
        self.holders: dict[bytes, list[int]] = {}
        for i, (_, _, p) in enumerate(made):
            for x in p:
                self.holders.setdefault(x, []).append(i)
        # of words with no pair in any template there is no need to look further
        self.words = frozenset(w for x in self.holders for w in x.split())
        self.bodies = [(name, _WORD.findall(text.encode().lower())) for name, text in templates]
        self.sets = [set(zip(w, w[1:])) for _, w in self.bodies]
        # a window that matches holds least / (2 - least) of a template's pairs, so one of any choice of more than the others
        self.anchors: dict[tuple[bytes, bytes], list[int]] = {}
        for i, own in enumerate(self.sets):
            spare = int(len(own) * (1 - least / (2 - least)) + 1e-9)
            for p in sorted(own, key=lambda p: (-len(p[0]) - len(p[1]), p))[: spare + 1]:
                self.anchors.setdefault(p, []).append(i)
        self.marks = frozenset(max(p, key=len) for p in self.anchors)

    def best(self, raw: bytes) -> tuple[float, str] | None:
        """Highest coefficient of a segment, and the first licence by name that has it."""
        least = self.least
        words = _WORD.findall(raw.lower())
        if len(words) - 1 < self.sizes[0] * least / (2 - least) - 1e-9:
            return None
        known = self.words
        # a match shares at least half the coefficient times the smaller size in pairs, and k pairs take k + 1 words
        if sum(w in known for w in words) < 1 + self.sizes[0] * least / 2 - 1e-9:
            return None
        own = {b"%b %b" % p for p in zip(words, words[1:])}
        # the coefficient itself decides on the border, where these bounds are rounded
        low = bisect_left(self.sizes, len(own) * least / (2 - least) - 1e-9)
        high = bisect_right(self.sizes, len(own) * (2 - least) / least + 1e-9)
        if low >= high:
            return None
        shared = Counter(i for x in own if x in self.holders for i in self.holders[x] if low <= i < high)
        found = [(-2 * c / (len(own) + self.sizes[i]), self.names[i]) for i, c in shared.items()]
        found = [x for x in found if -x[0] >= least]
        return (-min(found)[0], min(found)[1]) if found else None

    def windows(self, text: bytes) -> list[tuple[float, str, int, int]]:
        """(coefficient, name, first word, end) of all windows of a template's length that match, the best first."""
        words = _WORD.findall(text.lower())
        if self.marks.isdisjoint(words):
            return []
        all_pairs = list(zip(words, words[1:]))
        starts: dict[int, set[int]] = {}
        for i, p in enumerate(all_pairs):
            for t in self.anchors.get(p, ()):
                size = len(self.bodies[t][1])
                starts.setdefault(t, set()).update(range(max(0, i + 2 - size), min(i, max(0, len(words) - size)) + 1))
        found = []
        for t, at in starts.items():
            name, body = self.bodies[t]
            many: Counter[tuple[bytes, bytes]] = Counter()
            low = high = shared = 0  # pairs low to high are counted
            for a in sorted(at):
                end = min(a + len(body) - 1, len(all_pairs))
                if a >= high:
                    many.clear()
                    low = high = a
                    shared = 0
                for p in all_pairs[high:end]:
                    many[p] += 1
                    shared += many[p] == 1 and p in self.sets[t]
                for p in all_pairs[low:a]:
                    many[p] -= 1
                    if not many[p]:
                        del many[p]
                        shared -= p in self.sets[t]
                low, high = a, end
                dice = 2 * shared / (len(many) + len(self.sets[t]))
                if dice >= self.least:
                    found.append((dice, name, a, end + 1))
        return sorted(found, key=lambda x: (-x[0], x[1], x[2], -x[3]))

    def matches(self, text: bytes) -> list[tuple[float, str]]:
        """Those of the segments, then those of the best windows that meet neither a matching segment nor each other."""
        out = [m for s in segments(text) if (m := self.best(s))]
        windows = self.windows(text)
        taken = []
        if windows and out:
            for parts in (text.split(b"\n"), re.split(rb"\n[ \t\r]*\n", text), [text]):
                at = 0
                for s in parts:
                    n = len(_WORD.findall(s.lower()))
                    if self.best(s):
                        taken.append((at, at + n))
                    at += n
        for dice, name, a, end in windows:
            if all(end <= x or a >= y for x, y in taken):
                out.append((dice, name))
                taken.append((a, end))
        return out


def segments(text: bytes) -> Iterator[bytes]:
    """Lines, paragraphs of several lines, and a whole text of several paragraphs."""
    lines = text.split(b"\n")
    yield from lines
    if len(lines) > 1:
        blocks = re.split(rb"\n[ \t\r]*\n", text)
        yield from (p for p in blocks if b"\n" in p)
        if len(blocks) > 1:
            yield text


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, licence, dice, n_matches, licences.

    ``licence`` is that of the segment with the highest coefficient (the first by
    name among equals), ``n_matches`` counts matching segments, ``licences`` names
    all that they match, sorted. A text without a match, an empty or a null one
    has null, null, zero and an empty list. Rows are scanned one by one: repeated rows
    and ids have repeated results, and an empty table has none. Other columns of ``docs``
    are neither read nor returned, whatever their names.
    """
    made = Templates(templates or TEMPLATES, least)
    rows = scratch.spread(docs.select("doc_id", "text")).select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        for b in batches:
            found = [of.matches(x.as_py() or b"") for x in b.column(1)]
            top = [min(((-d, n) for d, n in f), default=(None, None)) for f in found]
            cols = [pa.array([n for _, n in top], pa.string()), pa.array([d and -d for d, _ in top], pa.float64()), pa.array([len(f) for f in found], pa.int64())]
            cols.append(pa.array([sorted({n for _, n in f}) for f in found], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "licence", "dice", "n_matches", "licences"])

    return rows.mapInArrow(run, f"doc_id {kind}, licence string, dice double, n_matches long, licences array<string>")
