"""Licence scans with a generalised suffix automaton of licence tokens."""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import cut, portions, table, words

LEAST_MATCH = 3  # tokens of a match that is chained
MOST_GAP = 12  # tokens between chained matches, in the text and in the template
LEAST_COVER = 0.7  # of a template's tokens that a reported span covers
LEAST_TOKENS = 3  # of a template

_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. {Neither} the name of the copyright holder nor the names of its contributors may be used to {endorse} or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def _gnu(program: str, name: str, version: str, later: bool = True) -> str:
    """The notice of a licence of the GNU family."""
    free = f"This {program} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} License as published by the Free Software Foundation"
    which = f", either version {{{version}}} of the License, or (at your option) any later version." if later else f", version {{{version}}} of the License."
    rest = f" This {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} License for more details."
    return free + which + rest


def _cc(name: str, short: str) -> list[str]:
    return [f"Licensed under {{{short} 4.0}}.", f"This work is licensed under a Creative Commons {{{name} 4.0}} International License.", f"This work is licensed under {{{short} 4.0}}."]


#: Licence texts, notices and characteristic passages. Words in braces, such as a version, must be matched.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the {MIT} License.",
        "Licensed under the {MIT} License.",
        "This project is licensed under the terms of the {MIT} license.",
        f"{_MIT_GRANT} {_MIT_WARRANTY}",
        _MIT_GRANT,
        _MIT_WARRANTY,
        "The above copyright notice and this permission notice shall be included in all copies",
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish",
    ],
    "Apache-2.0": [
        "Licensed under the {Apache} License, Version {2.0}.",
        "Licensed under the {Apache} License, Version {2.0} (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the {Apache} Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the {Apache} License, Version {2.0}",
    ],
    "Apache-1.1": ["Licensed under the {Apache} License, Version {1.1}.", "The {Apache} Software License, Version {1.1}"],
    "GPL-3.0": ["This work is licensed under the GNU {General} Public License, version {3}.", _gnu("program", "General Public", "3"), _gnu("program", "General Public", "3", False)],
    "GPL-2.0": ["This work is licensed under the GNU {General} Public License, version {2}.", _gnu("program", "General Public", "2"), _gnu("program", "General Public", "2", False)],
    "LGPL-3.0": ["This work is licensed under the GNU {Lesser} General Public License, version {3}.", _gnu("library", "{Lesser} General Public", "3")],
    "LGPL-2.1": ["This work is licensed under the GNU {Lesser} General Public License, version {2.1}.", _gnu("library", "{Lesser} General Public", "2.1")],
    "LGPL-2.0": [_gnu("library", "{Library} General Public", "2")],
    "AGPL-3.0": ["This work is licensed under the GNU {Affero} General Public License, version {3}.", _gnu("program", "{Affero} General Public", "3")],
    "BSD-3-Clause": [f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_WARRANTY}", f"{_BSD_GRANT} {_BSD_NAMES}", "Licensed under the {BSD 3} Clause License."],
    "BSD-2-Clause": [f"{_BSD_GRANT} {_BSD_WARRANTY}", "Licensed under the {BSD 2} Clause License."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, {provided} that the above copyright notice and this permission notice {appear} in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, {provided} that the above copyright notice and this permission notice {appear} in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Licensed under the {ISC} License.",
    ],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ],
    "BSL-1.0": [
        "Distributed under the {Boost} Software License, Version {1.0}.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the {Mozilla} Public License, v. {2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the {Mozilla} Public License, Version {2.0}."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the {Eclipse} Public License {2.0} which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "EPL-1.0": ["This program and the accompanying materials are made available under the terms of the {Eclipse} Public License v{1.0} which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "CC-BY-4.0": _cc("Attribution", "CC BY"),
    "CC-BY-SA-4.0": _cc("Attribution-ShareAlike", "CC BY-SA"),
    "CC-BY-NC-4.0": _cc("Attribution-NonCommercial", "CC BY-NC"),
    "CC-BY-ND-4.0": _cc("Attribution-NoDerivatives", "CC BY-ND"),
    "CC-BY-NC-SA-4.0": _cc("Attribution-NonCommercial-ShareAlike", "CC BY-NC-SA"),
    "CC-BY-NC-ND-4.0": _cc("Attribution-NonCommercial-NoDerivatives", "CC BY-NC-ND"),
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Licensed under {CC0 1.0}."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ],
    "WTFPL": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."],
    "All-Rights-Reserved": ["All rights reserved."],
    "Proprietary": ["Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential."],
}


class Automaton:
    """Suffix automaton of several token sequences: states with the longest substring they stand for, and for each state the ends of its occurrences (sequence, place)."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].add((k, place))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, token: int) -> int:
        if (q := self.next[last].get(token)) is not None:
            return q if self.length[last] + 1 == self.length[q] else self._split(last, token, q)
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[state] = q if self.length[p] + 1 == self.length[q] else self._split(p, token, q)
        return state

    def matches(self, tokens: list[int], least: int) -> list[tuple[int, int, int]]:
        """(stop, length, state) wherever the longest match that ends at a token can't be carried on, from `least` tokens on."""
        out, state, n = [], 0, 0
        for k, token in enumerate(tokens):
            to = self.next[state].get(token)
            if to is None:
                if n >= least:
                    out.append((k, n, state))
                while state and token not in self.next[state]:
                    state = self.link[state]
                n = self.length[state] if state else 0
                to = self.next[state].get(token, 0)
                n = n + 1 if to else 0
                state = to
            else:
                state, n = to, n + 1
        if n >= least:
            out.append((len(tokens), n, state))
        return out


def marked(template: str) -> tuple[list[str], set[int]]:
    """The words of a template, and the places of those in braces."""
    tokens, must = [], set()
    for k, part in enumerate(re.split(r"[{}]", template)):
        found = words(part)
        if k % 2:
            must.update(range(len(tokens), len(tokens) + len(found)))
        tokens += found
    return tokens, must


class Scanner:
    def __init__(self, templates: dict[str, list[str]]):
        named = [(name, *marked(text)) for name, texts in sorted(templates.items()) for text in texts]
        self.named = [(name, t, must) for name, t, must in named if len(t) >= LEAST_TOKENS]
        self.vocabulary: dict[str, int] = {}
        for _, t, _ in self.named:
            for w in t:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        coded = [[self.vocabulary[w] for w in t] for _, t, _ in self.named]
        self.automaton = Automaton(coded)
        self.base = len(self.vocabulary) + 1
        self.starts = np.unique(np.array([self.code(t[k : k + LEAST_MATCH]) for t in coded for k in range(len(t) - LEAST_MATCH + 1)], np.int64))

    def code(self, tokens: list) -> int:
        out = 0
        for t in tokens:
            out = out * self.base + t
        return out

    def runs(self, tokens: list[str]) -> list[tuple[int, list[int]]]:
        """Where every LEAST_MATCH tokens that follow one another do so in a template: no match reaches out of these."""
        get = self.vocabulary.get
        known = np.fromiter((get(w, 0) for w in tokens), np.int64, len(tokens))
        n = len(tokens) - LEAST_MATCH + 1
        if n <= 0 or not len(self.starts):
            return []
        there = np.flatnonzero(known[:n])
        codes = self.code([known[there + k] for k in range(LEAST_MATCH)])
        there = there[self.starts[np.minimum(np.searchsorted(self.starts, codes), len(self.starts) - 1)] == codes]
        if not len(there):
            return []
        first = np.flatnonzero(np.concatenate([[True], there[1:] != there[:-1] + 1]))
        last = np.append(first[1:], len(there)) - 1
        return [(int(a), known[a : b + LEAST_MATCH].tolist()) for a, b in zip(there[first], there[last], strict=True)]

    def pieces(self, tokens: list[str]) -> dict[int, list[tuple[int, int, int]]]:
        """The maximal matches with each template: (start in the text, start in the template, length), in order."""
        out: dict[int, set[tuple[int, int, int]]] = {}
        for start, run in self.runs(tokens):
            for stop, n, state in self.automaton.matches(run, LEAST_MATCH):
                for k, place in self.automaton.ends[state]:
                    out.setdefault(k, set()).add((start + stop - n, place - n + 1, n))
        return {k: sorted(v) for k, v in sorted(out.items())}

    def spans(self, tokens: list[str]) -> list[tuple[str, int, int, float]]:
        """(licence, start, stop, cover) of the reported spans, of overlapping ones the one that covers most."""
        found: list[tuple[float, int, int, str]] = []
        for k, of in self.pieces(tokens).items():
            name, template, must = self.named[k]
            for chain in chains(of):
                cover = sum(n for _, _, n in chain) / len(template)
                if cover >= LEAST_COVER and must <= {p + j for _, p, n in chain for j in range(n)}:
                    found.append((cover, chain[0][0], chain[-1][0] + chain[-1][2], name))
        return resolved(found)


def resolved(found: list[tuple[float, int, int, str]]) -> list[tuple[str, int, int, float]]:
    """Of overlapping spans (cover, start, stop, licence) the one that covers most words; ties go to the earlier, then to the first name."""
    out: list[tuple[str, int, int, float]] = []
    taken: list[tuple[int, int]] = []
    for cover, start, stop, name in sorted(found, key=lambda f: (-(f[2] - f[1]) * f[0], f[1], f[3])):
        k = bisect.bisect_left(taken, (stop, 0))
        if k and taken[k - 1][1] > start:
            continue
        bisect.insort(taken, (start, stop))
        out.append((name, start, stop, round(cover, 6)))
    return sorted(out, key=lambda f: (f[1], f[2], f[0]))


def chains(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Pieces in chains that go forward in text and template with gaps of at most MOST_GAP: each piece follows the chain with which it covers most. Where a piece begins before the one that it follows ends, in the text or the template, it counts from there on only.

    The chains' ends are looked up by their place in the template; those more than MOST_GAP before a piece in the text are out of reach of all later ones and forgotten, so nothing depends on a template's length.
    """
    best: list[tuple[int, int, int]] = []  # words covered so far, the piece before, words of this one that count
    live: dict[int, list[tuple[int, int]]] = {}
    for k, (s, p, n) in enumerate(pieces):
        top = (n, -1, n)
        for end in range(p - MOST_GAP, p + n):
            if end in live:
                near = live[end] = [(e, j) for e, j in live[end] if s - e <= MOST_GAP]
                for e, j in near:
                    over = max(0, e - s, end - p)
                    if over < n and s + over - e <= MOST_GAP and p + over - end <= MOST_GAP and best[j][0] + n - over > top[0]:
                        top = (best[j][0] + n - over, j, n - over)
        best.append(top)
        live.setdefault(p + n, []).append((s + n, k))
    out, used = [], [False] * len(pieces)
    for k in sorted(range(len(pieces)), key=lambda k: (-best[k][0], k)):
        chain, at = [], k
        while at >= 0 and not used[at]:
            used[at] = True
            s, p, n = pieces[at]
            _, before, counts = best[at]
            if before >= 0 and not used[before]:
                chain.append((s + n - counts, p + n - counts, counts))
            else:
                chain.append((s, p, n))
            at = before
        if chain:
            out.append(chain[::-1])
    return out


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, licence, start_word, end_word, cover) of the licence texts and notices in each document.

    A document's lower-case words are streamed through the generalised suffix automaton of all templates. Maximal matches of at least LEAST_MATCH words are chained, in order and over gaps of at most MOST_GAP words, along each template; a span is reported if its matches cover LEAST_COVER of the template, and the words that the template has in braces. Where spans overlap, the one that covers most words stays; ties go to the earlier, then to the first name. Null and empty texts have none, so has an empty table or one scanned for no template; copies are reported each, row by row, whatever their doc_id; a null doc_id is passed on; very long texts are scanned whole; other columns, of any name, are ignored.
    """
    chosen = TEMPLATES if templates is None else templates

    def run(source):
        scanner = Scanner(chosen)
        for batch in cut(source):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(ids[k], *span) for a, b in portions(texts) for k in range(a, b) if texts[k] for span in scanner.spans(words(texts[k]))]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["doc_id", "licence", "start_word", "end_word", "cover"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, licence string, start_word int, end_word int, cover double")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
