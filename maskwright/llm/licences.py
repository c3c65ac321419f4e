"""Licence scan: a text against licence templates, by the Dice coefficient of their sets of word bigrams.

Text is normalised: lower case, and words are runs of ASCII letters and digits, dots inside numbers kept. Compared are, first, the
parts of a text as it is laid out: lines, the sentences of a line, paragraphs of several lines and the whole text; and
then, wherever they lie, all windows of as many words as a template has, over line ends, blank lines and sentences.

A template matches if 2 |A and B| / (|A| + |B|) is at least the threshold. As the intersection is no larger than the smaller set,
only templates whose size is between threshold / (2 - threshold) of a part's size and its inverse can match; they are a
slice of the list of templates by size. The same bound prunes windows: a template is slid over a text only if at least
threshold / (2 - threshold) of its own bigrams occur in the whole text. Sliding counts the distinct bigrams of all
windows at once, from the place where each bigram occurred last.

Defined results: a null or empty text, or one with no word pairs, has no matches; an identifier that is no integer counts
as null. Of several parts on the same place (a line that is one sentence) one match is given; ties in score go to the
template whose name sorts first. Windows are taken best first, then by start; one that overlaps a part that matched, or a
window taken before, is left out. Rows are independent, so repeated rows and null identifiers get one result each. Extra
columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Wording of public licences and of usual notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for
more details."""
_AGPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for
more details."""
_EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for
the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to
https://unlicense.org"""
_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement,
including the above license grant, this restriction and the following disclaimer, must be included in all copies of the
Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are
solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR
ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC),
    ("ISC", "Licensed under the ISC License."),
    ("BSD-2-Clause", _BSD_2),
    ("BSD-3-Clause", _BSD_2 + " " + _BSD_3),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", _GPL),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("LGPL-2.1", _LGPL),
    ("AGPL-3.0", _AGPL),
    ("EPL-2.0", _EPL),
    ("Unlicense", _UNLICENSE),
    ("BSL-1.0", _BSL),
    ("MPL-2.0", _MPL),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "All rights reserved."),
)
# End of fixed values.

WORDS = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
SENTENCE = re.compile(r"[^.!?\s](?:[^.!?]|[.!?](?=\S))*[.!?]*")
PARAGRAPH = re.compile(r"[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)+")
LINE = re.compile(r"[^\n]*\S[^\n]*")

Match = tuple[str, int, int, float]


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    words = WORDS.findall(lowered(text))
    return frozenset(zip(words, words[1:], strict=False))


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


@dataclass(frozen=True)
class Template:
    name: str
    words: int
    bigrams: frozenset

    @property
    def size(self) -> int:
        return len(self.bigrams)


class Templates:
    """Templates by size, with the bounds that prune them."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.8) -> None:
        self.threshold, self.least = threshold, threshold / (2 - threshold)
        every = (Template(name, len(WORDS.findall(lowered(text))), bigrams(text)) for name, text in templates)
        self.own = sorted((t for t in every if t.size), key=lambda t: (t.size, t.name))
        self.sizes = [t.size for t in self.own]

    @cached_property
    def any_bigram(self) -> frozenset:
        return frozenset().union(*(t.bigrams for t in self.own))

    def best(self, part: frozenset) -> tuple[str, float] | None:
        """The best template of at least the threshold."""
        n = len(part)
        found: tuple[float, str] | None = None
        for t in self.own[bisect_left(self.sizes, self.least * n - 1e-9) : bisect_right(self.sizes, n / self.least + 1e-9)]:
            score = dice(part, t.bigrams)
            if score >= self.threshold and (found is None or (-score, t.name) < found):
                found = (-score, t.name)
        return found and (found[1], -found[0])

    def scan(self, text: str) -> list[Match]:
        """Matches (licence, start, end, score) in code points, by start; the larger part of a place first."""
        found, seen = self.in_parts(text)
        if any(len(seen & t.bigrams) >= self.least * t.size for t in self.own):
            taken = [m[1:3] for m in found]
            for match in self.in_windows(text, seen):
                if not any(a < match[2] and match[1] < b for a, b in taken):
                    found.append(match)
                    taken.append(match[1:3])
        return sorted(found, key=lambda m: (m[1], -m[2]))

    def in_parts(self, text: str) -> tuple[list[Match], set]:
        """Matches of lines, sentences, paragraphs and the whole text, and the bigrams of templates that the text has."""
        found: dict[tuple[int, int], Match] = {}

        def tried(a: int, b: int, own: frozenset) -> None:
            if (a, b) not in found and own and not own.isdisjoint(self.any_bigram) and (match := self.best(own)):
                found[a, b] = (match[0], a, b, match[1])

        most = self.sizes[-1] / self.least if self.sizes else 0
        whole: set[tuple[str, str]] = set()
        seen: set[tuple[str, str]] = set()
        last = ""
        for line in LINE.finditer(text):
            words = WORDS.findall(lowered(line.group()))
            own = frozenset(zip(words, words[1:], strict=False))
            if len(whole) <= most:
                whole |= own
            if words:  # a pair of words may reach over a line end
                if (last, words[0]) in self.any_bigram:
                    seen.add((last, words[0]))
                last = words[-1]
            if own.isdisjoint(self.any_bigram):
                continue
            seen |= own & self.any_bigram
            tried(line.start(), line.end(), own)
            parts = [m.span() for m in SENTENCE.finditer(line.group())]
            if len(parts) > 1:
                for a, b in parts:
                    tried(line.start() + a, line.start() + b, bigrams(line.group()[a:b]))
        if "\n" in text and seen:
            for block in PARAGRAPH.finditer(text):
                tried(*block.span(), bigrams(block.group()))
            if len(whole) <= most:
                tried(0, len(text), bigrams(text))
        return list(found.values()), seen

    def in_windows(self, text: str, seen: set) -> list[Match]:
        """Matches of windows of a template's number of words, best first, then by start and name; overlaps included.
        seen: bigrams of templates in the text."""
        low = lowered(text)
        places = [m.span() for m in WORDS.finditer(low)]
        words = [low[a:b] for a, b in places]
        pairs = list(zip(words, words[1:], strict=False))
        numbers: dict[tuple[str, str], int] = {}
        ids = np.fromiter((numbers.setdefault(p, len(numbers)) for p in pairs), np.int64, len(pairs))
        last = last_places(ids)
        found = []
        for t in self.own:
            if len(seen & t.bigrams) < self.least * t.size or t.words > len(words):
                continue
            own = np.zeros(len(numbers) + 1, bool)
            own[[numbers[p] for p in t.bigrams if p in numbers]] = True
            size = t.words - 1
            common, all_of = distinct_in_windows(last, own[ids], size), distinct_in_windows(last, np.ones(len(ids), bool), size)
            score = 2 * common / (all_of + t.size)
            found += [(t.name, places[i][0], places[i + size][1], float(score[i])) for i in np.flatnonzero(score >= self.threshold).tolist()]
        return sorted(found, key=lambda m: (-m[3], m[1], m[0], m[2]))


def lowered(text: str) -> str:
    """Lower case that keeps every place: what has a longer or an ASCII lower case without being ASCII is no letter here."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def last_places(ids: np.ndarray) -> np.ndarray:
    """For each place the one before it with the same id, or -1."""
    by = np.argsort(ids, kind="stable")
    last = np.full(len(ids), -1)
    same = ids[by][1:] == ids[by][:-1]
    last[by[1:][same]] = by[:-1][same]
    return last


def distinct_in_windows(last: np.ndarray, counted: np.ndarray, size: int) -> np.ndarray:
    """For each window of `size` places, how many different ids it has among the counted places. A place is the first of its id
    in the windows that begin after the place before it with that id."""
    n = len(last)
    at = np.flatnonzero(counted)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(last[at] + 1, at - size + 1).clip(0), 1)
    np.subtract.at(change, at + 1, 1)
    return np.cumsum(change)[: max(0, n - size + 1)]


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_matches", pa.int64()), ("licence", pa.string()), ("score", pa.float64()), ("licences", pa.string()), ("spans", pa.string())]
)


def scan_licences(documents: DataFrame, templates: Templates | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: doc_id, n_matches, the best match's licence and score (null without a match), all
    licences found (sorted, comma-joined), spans (licence:start:end, comma-joined by start). No shuffle."""
    templates = templates or Templates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = templates.scan(text or "")
                best = min(found, key=lambda m: (-m[3], m[0])) if found else (None, 0, 0, None)
                names, spans = ",".join(sorted({m[0] for m in found})), ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found)
                rows.append({"doc_id": i, "n_matches": len(found), "licence": best[0], "score": best[3], "licences": names, "spans": spans})
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    picked = documents.select(documents[id_col].try_cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_matches long, licence string, score double, licences string, spans string")
