"""Licence scanning with a generalised suffix automaton.

The automaton holds every run of words of every template. A text is streamed
through it: the matching statistics say, at each word, how long a run ending there
occurs in a template. Long matches are chained, template by template, into spans;
a template's covered share is its score. Short phrases are looked for in the same
stream.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilscan.llm.common import chunks, words

#: Phrases whose places are all counted, with their labels (fixed values).
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Wording of well-known licences (fixed values: public licence texts), with labels.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
    "later version.",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
    "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
    "publish, use, compile, sell, or distribute this software",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
}

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
_HOLDERS_NOT_LIABLE = (
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission."
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GPL_REST = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
    "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
    "furnished to do so"
)

#: Whole licences and whole notices (fixed values: public licence texts), with labels.
TEMPLATES |= {
    "mit-license": f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be "
    f"included in all copies or substantial portions of the Software. {_AS_IS} {_HOLDERS_NOT_LIABLE}",
    "mit-0": f"{_MIT_GRANT}. {_AS_IS} {_HOLDERS_NOT_LIABLE}",
    "x11": f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included "
    f"in all copies or substantial portions of the Software. {_AS_IS} IN NO EVENT SHALL THE X CONSORTIUM BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. Except as contained in this notice, the name of the X Consortium shall not "
    "be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written "
    "authorization from the X Consortium.",
    "json-license": f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the Software. The Software shall be used for Good, not Evil. "
    f"{_AS_IS} {_HOLDERS_NOT_LIABLE}",
    "bsd-2-clause": f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}",
    "bsd-3-clause": f"{_BSD_CONDITIONS} {_BSD_THIRD} {_BSD_DISCLAIMER}",
    "isc-license": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_DISCLAIMER,
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
    + _ISC_DISCLAIMER,
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
    "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
    "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The "
    "origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
    "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
    "versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be "
    "removed or altered from any source distribution.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
    "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial "
    "or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software "
    "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
    "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment "
    "in perpetuity of all present and future rights to this software under copyright law. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "boost-1": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
    "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and "
    "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is "
    "furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the "
    "above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or "
    "in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of "
    "machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
    "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, "
    "TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES "
    "OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
    "OTHER DEALINGS IN THE SOFTWARE.",
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO "
    "WHAT THE FUCK YOU WANT TO.",
    "postgresql": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and "
    "without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two "
    "paragraphs appear in all copies. IN NO EVENT SHALL THE UNIVERSITY OF CALIFORNIA BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, "
    "SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS "
    "DOCUMENTATION, EVEN IF THE UNIVERSITY OF CALIFORNIA HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE. THE UNIVERSITY OF "
    "CALIFORNIA SPECIFICALLY DISCLAIMS ANY WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE. THE SOFTWARE PROVIDED HEREUNDER IS ON AN \"AS IS\" BASIS, AND THE UNIVERSITY OF CALIFORNIA HAS NO "
    "OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS, OR MODIFICATIONS.",
    "fair": "Usage of the works is permitted provided that this instrument is retained with the works, so that any entity that uses the "
    "works is notified of this instrument. DISCLAIMER: THE WORKS ARE WITHOUT WARRANTY.",
    "apache-2-whole-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
    "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
    "and limitations under the License.",
    "gpl-2-whole-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
    f"version. {_GPL_REST} You should have received a copy of the GNU General Public License along with this program; if not, write to "
    "the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "gpl-3-whole-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
    f"version. {_GPL_REST} You should have received a copy of the GNU General Public License along with this program. If not, see "
    "<https://www.gnu.org/licenses/>.",
    "lgpl-2.1-whole-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
    "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any "
    "later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You "
    "should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software "
    "Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "agpl-3-whole-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
    "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You "
    "should have received a copy of the GNU Affero General Public License along with this program. If not, see "
    "<https://www.gnu.org/licenses/>.",
    "epl-2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
    "which is available at https://www.eclipse.org/legal/epl-2.0/",
}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


class SuffixAutomaton:
    """States of all runs of words of several word lists; ``ends[s]`` lists (list, place) where a state's runs end.

    ``whole[s]`` lists the lists that a state's longest run ends with.
    """

    def __init__(self, lists: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [[]]
        for number, items in enumerate(lists):
            last = 0
            for place, item in enumerate(items):
                last = self._append(last, item)
                self.ends[last].append((number, place))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]].extend(self.ends[state])
        self.ends[0] = []
        self.whole: list[list[int]] = [[] for _ in self.link]
        for number, items in enumerate(lists):
            state = 0
            for item in items:
                state = self.next[state][item]
            self.whole[state].append(number)
        for state in sorted(range(1, len(self.link)), key=lambda s: self.length[s]):
            self.whole[state] = self.whole[state] + self.whole[self.link[state]]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, parent: int, item: int) -> int:
        """The state of ``item`` after ``parent``, cut from a longer one if it must be."""
        target = self.next[parent][item]
        if self.length[target] == self.length[parent] + 1:
            return target
        copy = self._state(self.length[parent] + 1)
        self.next[copy] = dict(self.next[target])
        self.link[copy], self.link[target] = self.link[target], copy
        while parent >= 0 and self.next[parent].get(item) == target:
            self.next[parent][item] = copy
            parent = self.link[parent]
        return copy

    def _append(self, last: int, item: int) -> int:
        if item in self.next[last]:
            return self._split(last, item)
        state = self._state(self.length[last] + 1)
        while last >= 0 and item not in self.next[last]:
            self.next[last][item] = state
            last = self.link[last]
        self.link[state] = self._split(last, item) if last >= 0 else 0
        return state

    def statistics(self, items: list[int]) -> list[tuple[int, int]]:
        """At each item, the length of the longest run ending there that occurs in a list, and its state."""
        state = length = 0
        out = []
        for item in items:
            while state and item not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if item in self.next[state]:
                state, length = self.next[state][item], length + 1
            out.append((length, state))
        return out


@dataclass
class Scanner:
    """The automaton of phrases and templates, and what it takes to count a template as found."""

    phrases: dict[str, str]
    templates: dict[str, str]
    least_match: int = 4
    least_cover: float = 0.6
    gap: int = 40

    def __post_init__(self) -> None:
        self.lists = [split_words(t) for t in [*self.phrases, *self.templates.values()]]
        self.labels = [*self.phrases.values(), *self.templates]
        self.count = len(self.phrases)
        self.numbers = {w: i for i, w in enumerate(sorted({w for words_ in self.lists for w in words_}))}
        self.automaton = SuffixAutomaton([[self.numbers[w] for w in words_] for words_ in self.lists])
        self.shortest = min([self.least_match, *(len(w) for w in self.lists[: self.count])])

    def runs(self, items: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Places (start, phrase) of phrases and matches (start, length, template, place in it) of one run of known words."""
        found, matches = [], []
        statistics = self.automaton.statistics(items)
        for at, (length, state) in enumerate(statistics):
            if length < self.shortest:
                continue
            for number in self.automaton.whole[state]:
                if number < self.count and length >= len(self.lists[number]):
                    found.append((at - len(self.lists[number]) + 1, number))
            grows = at + 1 < len(statistics) and statistics[at + 1][0] > length
            if length >= self.least_match and not grows:
                matches += [(at - length + 1, length, n, p - length + 1) for n, p in self.automaton.ends[state] if n >= self.count]
        return found, matches

    def chained(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Spans (template, start, end, share of the template covered) of matches in text order.

        A match goes on with a span of its template if it comes within ``gap``
        words and farther on in the template; what overlaps counts once.
        """
        open_spans: dict[int, list] = {}
        spans = []

        def close(number: int) -> None:
            start, end, _, covered = open_spans.pop(number)
            share = covered / len(self.lists[number])
            if share >= self.least_cover:
                spans.append((number, start, end, min(share, 1.0)))

        for start, length, number, place in sorted(matches, key=lambda m: (m[0], m[3])):
            if number in open_spans:
                span = open_spans[number]
                fresh = place + length - max(place, span[2])
                if start - span[1] <= self.gap and fresh > 0:
                    span[1], span[2], span[3] = max(span[1], start + length), place + length, span[3] + fresh
                    continue
                if length <= span[3] and start - span[1] <= self.gap:
                    continue
                close(number)
            open_spans[number] = [start, start + length, place + length, length]
        for number in list(open_spans):
            close(number)
        return sorted(spans, key=lambda s: (s[1], s[0]))


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """``(id, text)`` to phrases' places and templates' spans.

    ``(id, n_words, places, spans)``: ``places`` is (start, label) of every
    phrase, ``spans`` (start, end, label, share) of covered templates; starts
    count words from 0. Null counts as empty: no word, no place. Rows come back
    as often as they came in.
    """
    scanner = scanner or Scanner(PHRASES, TEMPLATES)
    kind = docs.schema["id"].dataType.simpleString()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(list(scanner.numbers), pa.string())
        hashes, _, _, _ = words(known)
        order = np.argsort(hashes)
        sorted_hashes, by_hash = hashes[order], np.array(list(scanner.numbers.values()))[order]
        place_type = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))
        for batch in chunks(batches):
            found, text, first, (data, starts, ends) = words(batch.column("text"))
            at = np.minimum(np.searchsorted(sorted_hashes, found), len(sorted_hashes) - 1)
            inside = sorted_hashes[at] == found
            # Unknown words and the ends of texts set the automaton back to its start, so each run of known words stands alone.
            change = np.diff(inside.astype(np.int8), prepend=0) != 0
            change[first[:-1][first[:-1] < len(found)]] = True
            begins = np.flatnonzero(change & inside)
            stops = np.append(np.flatnonzero(change), len(found))
            stops = stops[np.searchsorted(stops, begins, side="right")]
            long = stops - begins >= scanner.shortest
            places: list[list] = [[] for _ in range(batch.num_rows)]
            matches: list[list] = [[] for _ in range(batch.num_rows)]
            for a, b in zip(begins[long].tolist(), stops[long].tolist(), strict=True):
                row = int(text[a])
                offset = a - int(first[row])
                some, more = scanner.runs(by_hash[at[a:b]].tolist())
                places[row] += [{"start": s + offset, "label": scanner.labels[n]} for s, n in some]
                matches[row] += [(s + offset, length, n, p) for s, length, n, p in more]
            spans = [
                [{"start": s, "end": e, "label": scanner.labels[n], "share": c} for n, s, e, c in scanner.chained(m)] if m else []
                for m in matches
            ]
            columns = [batch.column("id"), pa.array(np.diff(first).astype(np.int64))]
            columns += [pa.array(places, place_type), pa.array(spans, span_type)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "places", "spans"])

    schema = f"id {kind}, n_words long, places array<struct<start:bigint,label:string>>"
    schema += ", spans array<struct<start:bigint,end:bigint,label:string,share:double>>"
    return docs.select("id", "text").mapInArrow(scanned, schema)
