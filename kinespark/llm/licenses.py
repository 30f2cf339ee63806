"""License scans by conditional compression.

A text is cut into candidate blocks: sliding windows of words, sized by a class of templates, that hold a word without
which no template of the class can agree. A block is compressed by itself and with each such template as raw zstandard
dictionary, and templates are ranked by the size they save. Those that save anything are confirmed, best first, by the
exact words that differ.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from kinespark.llm.common import keyed_text, small_batches

#: Share of a template's words that may differ in a confirmed notice (versions may not).
MOST_DIFFERENT = 0.1

# Wordings of public licenses, without the numbers of their clauses.
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
MIT_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", MIT_GRANT, f"{MIT_GRANT} {MIT_END}"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", " ".join([BSD_HEAD, BSD_SOURCE, BSD_BINARY, BSD_NAMES, BSD_END])],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", " ".join([BSD_HEAD, BSD_SOURCE, BSD_BINARY, BSD_END])],
    #: What both BSD licenses say: the clauses are not told.
    "BSD": [BSD_HEAD],
    "ISC": ["Licensed under the ISC License.", ISC_GRANT, f"{ISC_GRANT} {ISC_END}"],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "All-Rights-Reserved": ["All rights reserved."],
}


def templates() -> list[tuple[str, str]]:
    """(license, wording): the notices, and short forms with each version by rule."""
    out = [(name, text) for name, texts in NOTICES.items() for text in texts]
    for v in ("1.0", "1.1", "2.0"):
        out.append((f"Apache-{v}", f"Licensed under the Apache License, Version {v}."))
    for short, name in (("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"), ("AGPL", "GNU Affero General Public License")):
        for v in ("1", "2", "2.1", "3"):
            full = v if "." in v else v + ".0"
            out.append((f"{short}-{full}", f"This work is licensed under the {name}, version {v}."))
            out.append((f"{short}-{full}-or-later", f"under the terms of the {name} as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."))
    for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out.append((f"CC-{kind}-{v}", f"Licensed under CC {kind} {v}."))
    names = dict.fromkeys(name for name, _ in out if name not in ("BSD", "All-Rights-Reserved"))
    return out + [(name, f"SPDX-License-Identifier: {name}") for name in names]


_WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
#: The same parameters with and without a dictionary, so that nothing else changes the size.
_PARAMETERS = zstandard.ZstdCompressionParameters.from_level(3, source_size=4096, write_content_size=False, write_dict_id=False)
_PLAIN = zstandard.ZstdCompressor(compression_params=_PARAMETERS)
#: Most words of a template of each class; the last one takes all that are longer.
CLASSES = (8, 24, 64, 160)


def split(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, split(text)
        shared = zstandard.ZstdCompressionDict(" ".join(self.words).encode().ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zip = zstandard.ZstdCompressor(dict_data=shared, compression_params=_PARAMETERS)
        self.most = int(MOST_DIFFERENT * len(self.words) + 1e-9)
        #: More words than may differ, so a confirmed stretch has one of them; and the words that must not differ.
        self.anchors = frozenset(sorted(set(self.words), key=lambda w: (self.words.count(w) > 1, -len(w), w))[: self.most + 1])
        self.numbers = frozenset(w for w in self.words if any(map(str.isdigit, w)))
        self.places = {w: sum(1 << i for i, x in enumerate(self.words) if x == w) for w in self.words}


@lru_cache(maxsize=1)
def _templates() -> list[_Template]:
    return [_Template(*t) for t in templates()]


@lru_cache(maxsize=1)
def _classes() -> list[tuple[int, list[int], frozenset[str]]]:
    """(most words of a stretch, templates, their anchors) of each class of templates."""
    out = []
    sizes = [len(t.words) for t in _templates()]
    for low, high in zip((0, *CLASSES), (*CLASSES, max(sizes)), strict=True):
        own = [k for k, n in enumerate(sizes) if low < n <= high]
        if own:
            most = max(sizes[k] + _templates()[k].most for k in own)
            out.append((most, own, frozenset().union(*(_templates()[k].anchors for k in own))))
    return out


def stretches(words: list[str], t: _Template) -> Iterator[tuple[int, int, int]]:
    """(words that differ: added, missing or other; start; end) of the stretch from each word that differs the least from
    the template, where no more differ than may. A stretch without one of the template's words that hold digits is none."""
    want = t.words
    size, first = len(want), frozenset(want[: t.most + 1])
    known = [0]
    for w in words:
        known.append(known[-1] + (w in t.places))
    every = (1 << size) - 1
    for a, w in enumerate(words):
        if w not in first or known[min(len(words), a + size + t.most)] - known[a] < size - t.most:
            continue
        best, row = (t.most + 1, 0), every
        for e, w in enumerate(words[a : a + size + t.most], 1):
            there = row & t.places.get(w, 0)
            row = (row + there | row - there) & every
            n = max(e, size) - (size - row.bit_count())  # words in a longest common subsequence
            if n < best[0]:
                best = n, e
        n, e = best
        if n <= t.most and t.numbers <= set(words[a : a + e]):
            yield n, a, a + e


@lru_cache(maxsize=1)
def _finder() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for _, _, anchors in _classes():
        for w in anchors:
            out.add_word(w, w)
    out.make_automaton()
    return out


def ranked(block: str, templates: list[int]) -> list[tuple[float, int]]:
    """(share of the block's compressed size that is saved, template), the most first; without those that save nothing."""
    raw = block.encode("utf-8", "surrogatepass")
    alone = len(_PLAIN.compress(raw))
    saved = [((alone - len(_templates()[k].zip.compress(raw))) / alone, k) for k in templates]
    return sorted((x for x in saved if x[0] > 0), key=lambda x: (-x[0], x[1]))


def scan(text: str | None) -> list[tuple[str, int, int, float, int]]:
    """(license, start, end, gain, differing words) of each confirmed notice; spans are code points of its lines, the gain
    is the share of its block's size that the template saves.

    Notices may be broken over lines and stand anywhere in a line. Of all confirmed stretches, those with the most of a
    template's words come first, then those with the fewest that differ and those that save more; each takes its words.
    """
    low = (text or "").lower()
    if next(_finder().iter(low), None) is None:
        return []
    at = [m.span() for m in _WORD.finditer(low)]
    words = [low[a:b] for a, b in at]
    fitting: dict[tuple[int, int, int], tuple[int, float]] = {}
    for most, own, anchors in _classes():
        marks = [i for i, w in enumerate(words) if w in anchors]
        # blocks of twice the longest stretch, each begun half a block after the one before: any stretch is whole in one
        for number in sorted({n for i in marks for n in (i // most - 1, i // most) if n >= 0}):
            a, b = number * most, min(len(words), (number + 2) * most)
            have = set(words[a:b])
            may = [k for k in own if not have.isdisjoint(_templates()[k].anchors) and _templates()[k].numbers <= have]
            if may:
                for gain, k in ranked(" ".join(words[a:b]), may):
                    for n, x, y in stretches(words[a:b], _templates()[k]):
                        key = (k, a + x, a + y)
                        fitting[key] = n, max(gain, fitting.get(key, (0, 0.0))[1])
    if not fitting:
        return []
    ends = [m.start() for m in re.finditer("\n", low)]  # lower case adds no lines
    bounds = [-1, *(m.start() for m in re.finditer("\n", text)), len(text)]
    out: dict[tuple[str, int, int], tuple[float, int]] = {}
    taken = bytearray(len(words))
    for (k, a, b), (n, gain) in sorted(fitting.items(), key=lambda x: (x[1][0] - len(_templates()[x[0][0]].words), x[1][0], -x[1][1], x[0])):
        if not any(taken[a:b]):
            first, last = bisect_left(ends, at[a][0]), bisect_left(ends, at[b - 1][0])
            out.setdefault((_templates()[k].name, bounds[first] + 1, bounds[last + 1]), (round(gain, 4), n))
            taken[a:b] = b"\1" * (b - a)
    return sorted((name, a, b, *v) for (name, a, b), v in out.items())


def scan_licenses(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Confirmed license notices, a row for each row of documents: n_licenses, licenses (name:start:end:differences,
    comma-joined, by name and start) and the best share of size saved.

    Null and empty texts have none; equal texts and repeated rows get equal results; texts of any length are cut into
    blocks whole; equally good templates of one place are taken in their order. Other columns are not read.
    """
    small_batches(documents.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t) for t in batch.column(1).to_pylist()]
            text = [",".join(f"{name}:{a}:{b}:{n}" for name, a, b, _, n in f) for f in found]
            best = [max((x[3] for x in f), default=None) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array(text, pa.string()), pa.array(best, pa.float64())], names=["doc_id", "n_licenses", "licenses", "best_gain"])

    return keyed_text(documents, id_col, text_col).mapInArrow(work, "doc_id long, n_licenses long, licenses string, best_gain double")
