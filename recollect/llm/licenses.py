"""License scans: plain phrases, and template mark-up compiled to automata over words.

A template is a license's text, or the notice that it asks for, with mark-up: ``[optional words]`` and
``<replaceable:most words>``, or as published templates have it, ``<<beginOptional>> .. <<endOptional>>``
and ``<<var;name="x";original="y";match=".{0,200}">>`` (a word for each five characters). It is compiled to
a non-deterministic automaton over words; a text holds the license where the automaton accepts a stretch
of its words, so mandatory wording must match exactly, and only that counts: two templates that both
match give both labels. A whole license scores 1, a notice or a short reference less, a license's
opening without the rest little, under a label of its own. A template without mandatory words holds nowhere.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. A null text counts
as empty; null or repeated ids are passed on; an empty table gives an empty table; whole texts are
scanned, however long; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, quoted

#: Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: How sure a match of a whole license, of a license's notice, of a short reference, of an opening alone, and of a plain phrase is.
WHOLE, NOTICE, SHORT, OPENING, PHRASE_CONFIDENCE = 1.0, 0.95, 0.9, 0.5, 0.7

# Wording of licenses (fixed values).
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the [\"]Software[\"]), to deal in the Software without restriction"
_MIT = _MIT_GRANT + """, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice [(including the next paragraph)] shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <holder:20> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_GRANT = "Redistribution and use [of this software] in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TERMS = """: [1.] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
[2.] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution. """
_BSD_ENDORSE = "[3.] Neither the name of <holder:30> nor the names of [its] [<others:10>] contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <holder:30> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <holder:30> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""
_ISC = """Permission to use, copy, modify, and[/or] distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <holder:12> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <holder:12> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will <holder:12> be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
[1.] The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. [2.] Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
[3.] This notice may not be removed or altered from any source distribution"""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use <things:12> except in compliance with the License. You may obtain a copy of the License at
[https] [http] [://] [www.] apache.org/licenses/LICENSE-2.0 [.txt] [.html] Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
[https] [http] [://] [www.] mozilla.org/MPL/2.0"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use,
reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in
whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor"""


def _gnu(name: str, version: str) -> str:
    """The notice that a work under a license of this family carries."""
    return f"""[This program] [This library] [<work:8>] is free software[:] [;] you can redistribute it and/or modify it under the terms of {name} as published by the Free Software Foundation[,] [;] [either] version {version}
of the License[, or (at your option) any later version]. [This program] [This library] [<work:8>] is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See {name} for more details"""


#: Templates: label, confidence, mark-up.
TEMPLATES = (
    ("mit", WHOLE, _MIT),
    ("bsd-2-clause", WHOLE, _BSD_GRANT + _BSD_TERMS + _BSD_DISCLAIMER),
    ("bsd-3-clause", WHOLE, _BSD_GRANT + _BSD_TERMS + _BSD_ENDORSE + _BSD_DISCLAIMER),
    ("isc", WHOLE, _ISC),
    ("zlib", WHOLE, _ZLIB),
    ("unlicense", WHOLE, _UNLICENSE),
    ("boost-1.0", NOTICE, _BOOST),
    ("apache-2.0", NOTICE, _APACHE),
    ("mpl-2.0", NOTICE, _MPL),
    ("gpl-2.0", NOTICE, _gnu("the GNU General Public License", "2")),
    ("gpl-3.0", NOTICE, _gnu("the GNU General Public License", "3")),
    ("lgpl-2.1", NOTICE, _gnu("the GNU Lesser General Public License", "2.1")),
    ("lgpl-3.0", NOTICE, _gnu("the GNU Lesser General Public License", "3")),
    ("agpl-3.0", NOTICE, _gnu("the GNU Affero General Public License", "3")),
    ("apache-2.0", SHORT, "licensed under the apache license[,] version 2.0 [(the license)]"),
    ("gpl-3.0", SHORT, "[this <work:4> is] licensed under the gnu general public license[,] version 3 [or [at your option any] later [version]]"),
    ("gpl-2.0", SHORT, "[this <work:4> is] licensed under the gnu general public license[,] version 2 [or [at your option any] later [version]]"),
    ("lgpl-2.1", SHORT, "licensed under the gnu lesser general public license[,] version 2.1"),
    ("lgpl-3.0", SHORT, "licensed under the gnu lesser general public license[,] version 3"),
    ("agpl-3.0", SHORT, "licensed under the gnu affero general public license[,] version 3"),
    ("mpl-2.0", SHORT, "licensed under the mozilla public license[,] version 2.0"),
    ("mit", SHORT, "[this <work:4> is] released under the [terms of the] mit license"),
    ("mit", SHORT, "[this <work:4> is] licensed under the [terms of the] mit license"),
    ("bsd-2-clause", SHORT, "licensed under the [terms of the] bsd 2 clause license"),
    ("bsd-3-clause", SHORT, "licensed under the [terms of the] bsd 3 clause license"),
    ("isc", SHORT, "licensed under the [terms of the] isc license"),
    ("cc0-1.0", SHORT, "[creative commons] cc0 1.0 [universal]"),
    ("cc-by-nc-4.0", SHORT, "licensed under [a] [the] [creative commons] cc by nc 4.0 [international] [license]"),
    ("cc-by-sa-4.0", SHORT, "licensed under [a] [the] [creative commons] cc by sa 4.0 [international] [license]"),
    ("cc-by-4.0", SHORT, "licensed under [a] [the] [creative commons] cc by 4.0 [international] [license]"),
    ("mit-opening", OPENING, _MIT_GRANT),
    ("bsd-opening", OPENING, _BSD_GRANT),
    ("all-rights-reserved", OPENING, "copyright <holder:40> all rights reserved"),
)

#: Every byte that isn't part of a word becomes a space; A-Z become a-z.
_TO_WORDS = bytes((b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20) for b in range(256))


_MARKS = re.compile(r"(<<beginOptional[^>]*>>)|(<<endOptional[^>]*>>)|(<<var;.*?>>)|(\[)|(\])|<[^:<>]*:(\d+)>", re.DOTALL)


def _words(text: str) -> list[str]:
    return [w.decode() for w in text.encode().translate(_TO_WORDS).split()]


def _parsed(markup: str) -> list[str]:
    """Words, ``[`` and ``]``, and ``<:n>`` for up to n words of any kind."""
    out, at = [], 0
    for m in _MARKS.finditer(markup):
        out += _words(markup[at : m.start()])
        at = m.end()
        if m[3]:
            length = re.search(r"\{\d*,(\d+)\}", m[3])
            out.append(f"<:{max(1, int(length[1]) // 5) if length else 50}>")
        else:
            out.append("[" if m[1] or m[4] else "]" if m[2] or m[5] else f"<:{m[6]}>")
    return out + _words(markup[at:])


class Automaton:
    """States are numbers; ``step[s]`` has (word or None for any, next state), ``free[s]`` the states reached without a word."""

    def __init__(self, markup: str):
        self.step: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[set[int]] = [set()]
        tokens = _parsed(markup)
        self.required = [t.encode() for t in self._outside(tokens)]
        self.final, rest = self._build(tokens, 0, 0)
        if rest != len(tokens):
            raise ValueError(f"unbalanced mark-up: {markup}")

    @staticmethod
    def _outside(tokens: list[str]) -> list[str]:
        depth, out = 0, []
        for t in tokens:
            depth += (t == "[") - (t == "]")
            if not depth and t[0] not in "[]<":
                out.append(t)
        return out

    def _state(self) -> int:
        self.step.append([])
        self.free.append(set())
        return len(self.step) - 1

    def _build(self, tokens: list[str], i: int, at: int) -> tuple[int, int]:
        while i < len(tokens) and tokens[i] != "]":
            t = tokens[i]
            if t == "[":
                end, i = self._build(tokens, i + 1, at)
                if i >= len(tokens):
                    raise ValueError("an optional part isn't closed")
                joint = self._state()
                self.free[end].add(joint)
                self.free[at].add(joint)
                at = joint
            elif t.startswith("<:"):
                joint = self._state()
                self.free[at].add(joint)
                for _ in range(int(t[2:-1])):
                    after = self._state()
                    self.step[at].append((None, after))
                    self.free[after].add(joint)
                    at = after
                at = joint
            else:
                after = self._state()
                self.step[at].append((t.encode(), after))
                at = after
            i += 1
        return at, i

    def _closed(self, states: set[int]) -> set[int]:
        out, waiting = set(states), list(states)
        while waiting:
            for s in self.free[waiting.pop()] - out:
                out.add(s)
                waiting.append(s)
        return out

    def accepts(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest accepted stretch that begins at word ``at``; None if there is none."""
        states, end = self._closed({0}), None
        while True:
            if self.final in states:
                end = at
            if at >= len(words) or not states:
                return end
            word = words[at]
            states = self._closed({after for s in states for w, after in self.step[s] if w is None or w == word})
            at += 1


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: tuple = TEMPLATES):
        self.phrases = {b" " + p.encode() + b" ": label for p, label in phrases.items()}
        self.templates = [t for t in ((name, confidence, Automaton(markup)) for name, confidence, markup in templates) if t[2].required]

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        """n_words, n_base, first_word, last_word, base labels, all labels, score."""
        words = text.translate(_TO_WORDS).split()
        line = b" " + b" ".join(words) + b" "
        starts, base, labels, score = [], set(), set(), 0.0
        for phrase, label in self.phrases.items():
            places = list(self._begins(line, phrase))
            starts += places
            if places:
                base.add(label)
        if base:
            score = PHRASE_CONFIDENCE
        for name, confidence, automaton in self.templates:
            # What may stand before the first mandatory word may be missing too, so a stretch can begin there.
            if all(b" " + w + b" " in line for w in automaton.required) and any(automaton.accepts(words, i) is not None for i in self._begins(line, b" " + automaton.required[0] + b" ")):
                labels.add(name)
                score = max(score, confidence)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score

    @staticmethod
    def _begins(line: bytes, key: bytes) -> Iterator[int]:
        """Numbers of the words at which a key (words between spaces) stands."""
        at = -1
        seen = number = 0
        while (at := line.find(key, at + 1)) >= 0:
            number += line.count(b" ", seen, at)
            seen = at
            yield number


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates: tuple = TEMPLATES) -> DataFrame:
    """One row per document: ``doc_id`` and FIELDS."""
    df = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    names = ["doc_id", *(f.split()[0] for f in FIELDS.split(", "))]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            rows = [scanner.scan(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return map_batches(df, run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {FIELDS}")
