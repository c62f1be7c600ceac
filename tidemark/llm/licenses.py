"""Licence scans by matching statistics against a generalised suffix automaton of licence tokens.

The automaton holds the words of every template and base phrase and is small and
of fixed size.  Each text is streamed once: at every word the automaton gives the longest run
of template words that ends there.  Base phrases are read off the states (a phrase ends at a word
if its state is the current one or one of its suffix links).  Maximal runs of at
least ``min_run`` words are chained per template, in order in both text and template and with at most ``max_gap`` words of the
text between two.  What a run shares with the one before it, in the text or in the template, counts once, so a
chain never covers more words than either has.  A chain that covers ``min_cover`` of a template's words is a span: label, first and last
word in the text, covered share; of spans of a template that overlap the best stays.  Spans give the labels.

score: the largest covered share of a template, at least 0.5 where a base phrase stands.

Defined cases: null, empty and word-less texts have no words, no labels, no spans and score 0; texts
of any length are streamed whole, in memory of some hundred bytes a word; null ids stay null; of chains that cover the same the one
that starts first stays; repeated rows are scanned each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.automaton import SuffixAutomaton
from tidemark.llm.common import ALNUM, per_batch, texts

#: Phrases that are licence mentions by themselves, and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Texts, grants and notices of common licences, and their labels.
TEMPLATES = [
    ("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
        WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
        OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
        OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit-grant", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions"""),
    ("apache-text", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License."""),
    ("gpl-text", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the
        GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("lgpl-text", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This
        library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("bsd-text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor
        the names of its contributors may be used to endorse or promote products derived from this software without specific prior written
        permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
        EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
        DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc-text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
        AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
        EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
        LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
        WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib-text", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
        for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
        an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly
        marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any
        source distribution."""),
    ("unlicense-text", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means."""),
    ("mpl-text", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("cc-by-text", """This work is licensed under a Creative Commons Attribution 4.0 International License."""),
    ("cc-by-sa-text", """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."""),
    ("gpl-notice", """This work is licensed under the GNU General Public License, version 3."""),
    ("apache-notice", """Licensed under the Apache License, Version 2.0."""),
    ("mit-notice", """Released under the MIT License."""),
    ("cc-by-nc", """Licensed under CC BY-NC 4.0."""),
    ("reserved", """All rights reserved."""),
]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM).split()


class LicenseScanner:
    def __init__(
        self,
        phrases: dict[str, str] = BASE_PHRASES,
        templates: list[tuple[str, str]] = TEMPLATES,
        min_run: int = 3,
        min_cover: float = 0.6,
        max_gap: int = 24,
    ) -> None:
        self.min_run, self.min_cover, self.max_gap = min_run, min_cover, max_gap
        self.labels = [x for x, _ in templates]
        sequences = [words_of(t.encode()) for _, t in templates]
        base = [words_of(p.encode()) for p in phrases]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for s in [*sequences, *base] for w in s))}
        auto = self.auto = SuffixAutomaton()
        coded = [[self.ids[w] for w in s] for s in sequences]
        self.sizes = [len(s) for s in coded]
        for s in [*([self.ids[w] for w in p] for p in base), *coded]:
            auto.add(s)
        n = len(auto.next)
        #: for each state, the (template, end) places of its runs
        self.ends: list[set[tuple[int, int]]] = [set() for _ in range(n)]
        for k, s in enumerate(coded):
            for i, (state, _) in enumerate(auto.walk(s)):
                while state > 0:
                    self.ends[state].add((k, i + 1))
                    state = auto.link[state]
        #: for each state, the (size, label) of base phrases that end with its runs
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        for p, label in zip(base, phrases.values(), strict=True):
            *_, (at, _) = auto.walk([self.ids[w] for w in p])
            for state in range(1, n):
                up = state
                while up > 0 and up != at:
                    up = auto.link[up]
                if up == at:
                    self.phrases[state].append((len(p), label))

    def scan(self, text: bytes | None) -> tuple[int, int, int | None, int | None, str, str, float, list[tuple[str, int, int, float]]]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
        words = words_of(text)
        get = self.ids.get
        coded = [get(w, -1) for w in words]
        n_base, first, last, base = 0, None, None, set()
        chains: dict[int, list[tuple[int, int, int, int]]] = {}
        covered: dict[int, dict[int, tuple[int, int]]] = {}
        nxt, link, length, phrases, ends = self.auto.next, self.auto.link, self.auto.length, self.phrases, self.ends
        state = size = 0
        coded.append(-1)
        for i, t in enumerate(coded):
            if t < 0:
                if state and size >= self.min_run:
                    self._chain(ends[state], i, size, chains, covered)
                state = size = 0
                continue
            if t not in nxt[state]:
                if size >= self.min_run:
                    self._chain(ends[state], i, size, chains, covered)
                while state and t not in nxt[state]:
                    state = link[state]
                    size = length[state]
            state = nxt[state].get(t, 0)
            size = size + 1 if state else 0
            if phrases[state]:
                for n, label in phrases[state]:
                    if n <= size:
                        n_base += 1
                        base.add(label)
                        start = i + 1 - n
                        first = start if first is None or start < first else first
                        last = start if last is None or start > last else last
        spans, best = [], 0.0
        for k, own in covered.items():
            best = max(best, max(total for total, _ in own.values()) / self.sizes[k])
            free: list[tuple[int, int]] = []
            for begin, (total, end) in sorted(own.items(), key=lambda c: (-c[1][0], c[0])):
                if total >= self.min_cover * self.sizes[k] and all(end <= a or begin >= b for a, b in free):
                    free.append((begin, end))
                    spans.append((self.labels[k], begin, end - 1, total / self.sizes[k]))
        spans.sort(key=lambda s: (s[1], s[0]))
        found = base | {s[0] for s in spans}
        return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(found)), max(best, 0.5 if n_base else 0.0), spans

    def _chain(self, ends: set[tuple[int, int]], at: int, size: int, chains: dict, covered: dict) -> None:
        """A maximal run of ``size`` words that ends before word ``at`` joins or starts a chain of each template.

        Chains are (end in the text, end in the template, covered words, first word).
        """
        for k, end in sorted(ends):
            open_ = chains.setdefault(k, [])
            open_[:] = [c for c in open_ if at - size - c[0] <= self.max_gap]
            total, begin = size, at - size
            for text_end, own_end, so_far, first in open_:
                gain = size - max(0, text_end - (at - size), own_end - (end - size))
                if gain > 0 and text_end < at and own_end < end and (so_far + gain, -first) > (total, -begin):
                    total, begin = so_far + gain, first
            open_.append((at, end, total, begin))
            own = covered.setdefault(k, {})
            if total > own.get(begin, (0, 0))[0]:
                own[begin] = (total, at)


SPANS = "array<struct<label: string, first_word: long, last_word: long, cover: double>>"


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans: one row a document."""

    def make():
        scanner = LicenseScanner(**options)
        span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("cover", pa.float64())])
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [scanner.scan(t) for t in texts(b)]
            columns = [list(c) for c in zip(*rows, strict=True)]
            columns[7] = [[dict(zip(("label", "first_word", "last_word", "cover"), s, strict=True)) for s in own] for own in columns[7]]
            return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

        return f

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(
        per_batch(make),
        f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}",
    )
