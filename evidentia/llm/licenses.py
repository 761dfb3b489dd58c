"""License scans by a generalised suffix automaton of licence words.

All templates are put into one automaton of words. A text is streamed through it once, which
gives at each word the longest passage of any template that ends there; passages that can't
be carried on are long matches, and matches that follow each other both in the text and in
a template chain to the span that the template covers. A span names its licence if it covers
enough of the template, or holds a long passage that no other licence has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.text import as_bytes, bounded

# Phrases of the base scan, and texts of public licences: whole where they are short,
# else the whole notice that their authors ask for; statements are sentences by which texts are licensed.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
_MIT = """
    Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
    rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
    persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
    this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
    "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
    MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
    HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
    ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """
    Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
    this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
    distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
    promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
    COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
    IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
    COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
    DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
    BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
    (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
    POSSIBILITY OF SUCH DAMAGE."""
_ISC = """
    Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
    provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS
    IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
    MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
    DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
    NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """
    This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
    for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
    purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
    restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
    software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
    is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
    original software. 3. This notice may not be removed or altered from any source distribution."""
_BOOST = """
    Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
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
_UNLICENSE = """
    This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
    compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
    commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
    this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for
    the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
    overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
_APACHE = """
    Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
    License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
    law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
    WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
    permissions and limitations under the License."""
_MPL = """
    This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
    distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_GNU = """
    This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public
    License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any
    later version. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
    implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for
    more details. You should have received a copy of the GNU {name} General Public License along with this {work}."""
_STATEMENTS = {
    "mit": "Released under the MIT License",
    "apache-2": "Licensed under the Apache License, Version 2.0",
    "bsd": "Licensed under the BSD License",
    "mpl-2": "Licensed under the Mozilla Public License, version 2.0",
    "gpl-2": "Licensed under the GNU General Public License, version 2",
    "gpl-3": "Licensed under the GNU General Public License, version 3",
    "lgpl-3": "Licensed under the GNU Lesser General Public License, version 3",
    "agpl-3": "Licensed under the GNU Affero General Public License, version 3",
    "cc-by": "Licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "Licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
    "cc-by-sa": "Licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    "cc0": "To the extent possible under law, the author has waived all copyright and related rights to this work",
}
TEMPLATES = [
    *[("mit", _MIT), ("bsd", _BSD), ("isc", _ISC), ("zlib", _ZLIB), ("boost", _BOOST), ("unlicense", _UNLICENSE), ("apache-2", _APACHE), ("mpl-2", _MPL)],
    ("gpl-2", _GNU.format(work="program", name="", version="2")),
    ("gpl-3", _GNU.format(work="program", name="", version="3")),
    ("lgpl-2", _GNU.format(work="library", name="Lesser", version="2.1")),
    ("lgpl-3", _GNU.format(work="library", name="Lesser", version="3")),
    ("agpl-3", _GNU.format(work="program", name="Affero", version="3")),
    *_STATEMENTS.items(),
]
#: Words of a match worth chaining, of the widest gap in a chain, and the share of a template that names it.
MIN_MATCH = 3
MAX_GAP = 12
MIN_COVERAGE = 0.8
#: Words in a row that name a licence whatever share of it they are, if no other licence has them.
DISTINCT = 25
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str) -> list[str]:
    """Words of a text in lower case, as the scan takes them."""
    return [w.decode() for w in _WORD.findall(text.encode().lower())]


class Found(NamedTuple):
    """What a scan of one text gives; places count words from 0."""

    n_words: int
    base: list[tuple[str, int]]
    spans: list[tuple[str, int, int, float]]


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, templates: list[tuple[str, list[str]]], phrases: list[tuple[str, list[str]]]) -> None:
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.templates = [(label, len(words)) for label, words in templates]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (template, place) of each passage's last word
        for n, (_, words) in enumerate([*templates, *phrases]):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, self.ids.setdefault(word.encode(), len(self.ids)))
                if n < len(templates):
                    self.ends[last].add((n, at))
        # a state's places in templates are also those of all its suffixes
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[state]:
                self.ends[self.link[state]] |= self.ends[state]
        self.phrases: list[tuple[tuple[int, str], ...]] = [()] * len(self.link)
        whole = {self._walk(words): (len(words), label) for label, words in phrases}
        for state in sorted(range(1, len(self.link)), key=lambda s: self.length[s]):
            own = ((whole[state],) if state in whole else ()) + self.phrases[self.link[state]]
            self.phrases[state] = own

    def _walk(self, words: list[str]) -> int:
        state = 0
        for word in words:
            state = self.next[state][self.ids[word.encode()]]
        return state

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """The state for exactly `state` plus `word`, parted from longer members of `target` if need be."""
        if self.length[target] == self.length[state] + 1:
            return target
        part = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = part
            state = self.link[state]
        self.link[target] = part
        return part

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word, self.next[last][word])
        return new

    def scan(self, text: bytes) -> Found:
        words = _WORD.findall(text.lower())
        follow, link, length, phrases = self.next, self.link, self.length, self.phrases
        base: list[tuple[str, int]] = []
        matches: list[tuple[int, int, int]] = []
        state = size = 0
        for at, word in enumerate(map(self.ids.get, words)):
            if word is None or word not in follow[state]:
                if size >= MIN_MATCH:
                    matches.append((at, size, state))
                if word is None:
                    state = size = 0
                    continue
                while state and word not in follow[state]:
                    state = link[state]
                size = length[state]
                if word not in follow[state]:
                    continue
            state = follow[state][word]
            size += 1
            for width, label in phrases[state]:
                if size >= width:
                    base.append((label, at - width + 1))
        if size >= MIN_MATCH:
            matches.append((len(words), size, state))
        return Found(len(words), base, list(self._chains(matches)) if matches else [])

    def _chains(self, matches: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int, float]]:
        """Spans (label, start, stop, coverage) that chained matches cover enough of, the best of those that overlap.

        A match stands at each of its places in each template. It goes on with the chain of that
        template that covers most and lies before it, in the text and in the template, or begins one.
        """
        chains: dict[int, list[list]] = {}  # by template: start, stop, stop in the template, words covered, named
        done: list[tuple[int, int, int, int, bool]] = []

        def close(n: int, before: int) -> list[list]:
            """Chains that may go on; the others are done."""
            done.extend((c[3], n, c[0], c[1], c[4]) for c in chains.get(n, ()) if c[1] < before)
            return [c for c in chains.get(n, ()) if c[1] >= before]

        for stop, size, state in matches:
            begin = stop - size
            named = size >= DISTINCT and len({self.templates[n][0] for n, _ in self.ends[state]}) == 1
            for n in sorted({n for n, _ in self.ends[state]}):
                still, fresh = close(n, begin - MAX_GAP), {}
                for at in sorted(at + 1 for m, at in self.ends[state] if m == n):
                    ways = [(size, [begin, stop, at, size, named])]
                    for c in still:
                        if c[2] < at and c[1] < stop and at - size - c[2] <= MAX_GAP:
                            words = c[3] + min(size, stop - c[1], at - c[2])
                            ways.append((words, [c[0], stop, at, words, named or c[4]]))
                    fresh[at] = max(ways, key=lambda w: w[0])[1]
                chains[n] = still + list(fresh.values())
        for n in list(chains):
            chains[n] = close(n, 1 << 62)
        taken: dict[str, list[tuple[int, int]]] = {}
        for words, n, start, stop, named in sorted(done, key=lambda d: (-d[0], d[1], d[2])):
            label, total = self.templates[n]
            own = taken.setdefault(label, [])
            if (named or words >= MIN_COVERAGE * total) and not any(a < stop and start < b for a, b in own):
                own.append((start, stop))
                yield label, start, stop, min(1.0, words / total)


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    """The automaton of TEMPLATES and PHRASES."""
    return Automaton(
        [(label, words(text)) for label, text in TEMPLATES],
        [(label, text.split()) for text, label in PHRASES.items()],
    )


def scan(docs: DataFrame) -> DataFrame:
    """A row for every row of `docs`: doc_id, n_words, base (array of label, start) and spans (label, start, stop, coverage).

    Whole texts; a null text is empty and has neither; a null doc_id stays null; repeated rows each
    get a row; columns but doc_id and text aren't read, whatever their names.
    """
    schema = (
        "doc_id long, n_words long, base array<struct<label:string,start:long>>, "
        "spans array<struct<label:string,start:long,stop:long,coverage:double>>"
    )
    base_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    span_type = pa.list_(
        pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("coverage", pa.float64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in bounded(batches, "text"):
            found = [machine.scan(t or b"") for t in as_bytes(batch.column("text"))]
            base = [[{"label": a, "start": s} for a, s in f.base] for f in found]
            keys = ("label", "start", "stop", "coverage")
            spans = [[dict(zip(keys, s, strict=True)) for s in f.spans] for f in found]
            columns = [pa.array([f.n_words for f in found], pa.int64()), pa.array(base, base_type), pa.array(spans, span_type)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "base", "spans"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, schema)


def labels(docs: DataFrame) -> DataFrame:
    """`scan` with places and labels drawn together; score is 1 with a base phrase, else the best span's coverage."""
    starts = F.col("base.start")
    joined = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    best = F.coalesce(F.array_max("spans.coverage"), F.lit(0.0))
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "spans.label")).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(best).alias("score"),
    )
