"""License scans by patience alignment.

Text and template are words (runs of letters and digits, lower-cased). Words that occur once in both anchor the
alignment; the longest increasing subsequence of anchors is kept, and the gaps between kept anchors are aligned in the
same way. Coverage is the share of the template's words that the alignment matches. A template may occur anywhere in a
text and more than once, so alignment starts from places of the template's rarest words in the text: in a window of the
template's length at such a word's own place in the template, so that a neighbouring copy is outside, and in wider ones
for texts with words put in. Of a seed's alignments the one with most words counts, where each foreign word within costs
half a word; matches at its ends that cost more than they bring are trimmed.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingops.llm.common import ship

WORD = re.compile(r"[^\W_]+")

# Notices of public licenses.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT line": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "All rights reserved": "Copyright. All rights reserved.",
}

# Whole texts of short public licenses, without their copyright lines.
MIT_TEXT = TEMPLATES["MIT"] + """ THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_TEXT = TEMPLATES["ISC"] + """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_DISCLAIMER = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES |= {
    "MIT text": MIT_TEXT,
    "ISC text": ISC_TEXT,
    "BSD-2-Clause text": TEMPLATES["BSD-2-Clause"] + BSD_DISCLAIMER,
    "BSD-3-Clause text": TEMPLATES["BSD-2-Clause"] + " " + TEMPLATES["BSD-3-Clause endorsement"] + BSD_DISCLAIMER,
    "Zlib text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(WORD.finditer(text))
    return [m[0].lower() for m in found], [m.span() for m in found]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first, whose second members increase: patience sorting with back links."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for n, (_, y) in enumerate(pairs):
        p = bisect.bisect_left(tops, y)
        back.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(y)
            piles.append(n)
        else:
            tops[p], piles[p] = y, n
    out, n = [], piles[-1] if piles else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """(text position, template position) of matched words, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        where = {w: i for i, w in enumerate(text[a:b], a) if in_text[w] == 1 and in_template.get(w) == 1}
        anchors = increasing(sorted((where[w], j) for j, w in enumerate(template[c:d], c) if w in where))
        if not anchors:
            continue
        out += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def trimmed(pairs: list[tuple[int, int]]) -> tuple[float, list[tuple[int, int]]]:
    """The best run of pairs and its worth: a pair is worth 1, a text word between two pairs -0.5."""
    best, out, worth, first = 0.0, pairs[:0], 0.0, 0
    for n, (i, _) in enumerate(pairs):
        kept = worth - 0.5 * (i - pairs[n - 1][0] - 1) if n else 0.0
        if kept <= 0:
            kept, first = 0.0, n
        worth = kept + 1
        if worth > best:
            best, out = worth, pairs[first : n + 1]
    return best, out


class Scanner:
    """Templates with what a text must hold for a coverage of `least`."""

    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.templates = []
        split = {k: words_of(t)[0] for k, t in sorted(templates.items())}
        common = Counter(w for t in split.values() for w in set(t))
        for k, t in split.items():
            if t:
                checks = sorted(Counter(t).items(), key=lambda x: (common[x[0]] + (len(x[0]) < 5) * 100, x[0]))
                self.templates.append((k, t, [(w, n) for w, n in checks]))

    def possible(self, lower: str, template: list[str], checks: list[tuple[str, int]]) -> bool:
        """Whether enough of the template's words occur in the text at all; a word inside another counts, so none is missed."""
        may_miss = int(len(template) * (1 - self.least) + 1e-9)
        for w, n in checks:
            if w not in lower:
                may_miss -= n
                if may_miss < 0:
                    return False
        return True

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(template, start, end, coverage): matches in code points, by start; of overlapping ones that with most words."""
        lower = text.lower()
        words = None
        found: list[tuple[int, int, int, str, float]] = []
        for key, template, checks in self.templates:
            if not self.possible(lower, template, checks):
                continue
            if words is None:
                words, spans = words_of(text)
                places: dict[str, list[int]] = {}
                for i, w in enumerate(words):
                    places.setdefault(w, []).append(i)
            rare = min((w for w, _ in checks if w in places), key=lambda w: (len(places[w]), w), default=None)
            # coverage of `least` may lack the rarest word, so the next ones are tried until all that may be missing are
            may_miss, m = int(len(template) * (1 - self.least) + 1e-9), len(template)
            seeds, missed = set(), 0
            for w in sorted((w for w, _ in checks if w in places), key=lambda w: (len(places[w]), w)):
                seeds.update(places[w])
                missed += template.count(w)
                if missed > may_miss:
                    break
            if rare is None:
                continue
            own: list[tuple[int, int]] = []  # first and last + 1 word of this template's whole copies, disjoint, sorted
            where: dict[str, list[int]] = {}
            for j, w in enumerate(template):
                where.setdefault(w, []).append(j)
            for slacks in ((0,), (0, max(1, m // 4), m, 2 * m)):  # whole copies first, which bound the windows of others
                done, new = 0, []  # seeds come in order, so a match ends before the next
                for p in sorted(seeds):
                    i = bisect.bisect(own, (p, len(words)))
                    left, right = max(done, own[i - 1][1] if i else 0), own[i][0] if i < len(own) else len(words)
                    if p < left:
                        continue
                    best: tuple[float, list[tuple[int, int]]] = (0.0, [])
                    for low, high in dict.fromkeys((max(left, p - j - x), min(right, p - j + m + x)) for x in slacks for j in where[words[p]]):
                        pairs = [(low + i, j) for i, j in align(words[low:high], template)]
                        worth, short = trimmed(pairs)
                        if len(short) < self.least * m and pairs and pairs[-1][0] - pairs[0][0] < 2 * m:
                            worth, short = worth - m, pairs  # loose words, where there is no denser run
                        if len(short) >= self.least * m and (not best[1] or worth > best[0]):
                            best = worth, short
                    if best[1] and (len(slacks) > 1 or len(best[1]) == m == best[1][-1][0] - best[1][0][0] + 1):
                        s, done = best[1][0][0], best[1][-1][0] + 1
                        found.append((len(best[1]), spans[s][0], spans[done - 1][1], key, len(best[1]) / m))
                        new.append((s, done))
                own = new if len(slacks) == 1 else own
        found.sort(key=lambda x: (-x[0], -x[4], x[1], x[3]))
        out: list[tuple[str, int, int, float]] = []
        taken = bytearray(max((e for _, _, e, _, _ in found), default=0))
        for _, s, e, key, x in found:
            if taken.find(1, s, e) < 0:
                out.append((key, s, e, x))
                taken[s:e] = b"\1" * (e - s)
        return sorted(out, key=lambda x: (x[1], x[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, license, start, end, coverage of every match in docs(doc_id, text), over whole texts.

    Null and empty texts have none, nor have texts without enough of a template's words; a template without words
    matches nothing. Repeated rows give theirs each; other columns are ignored.
    """
    chosen = TEMPLATES if templates is None else templates
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("coverage", pa.float64())])

    def run(batches):
        scanner = Scanner(chosen, least)
        for batch in batches:
            out = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for x in scanner.scan(t)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, start int, end int, coverage double")
