"""Licence scans: a suffix automaton of licence texts, matching statistics of files, chains of long matches.

The automaton holds every run of words of every template. A file is streamed through it once: after each word it knows
the longest run of template words that ends there. Runs that cannot be extended and have MATCH words or more are
chained, in the order of the file and of the template alike, over small gaps (names, years, changed words). A chain
that covers enough of a template is a licence span. Short phrases are found in the same pass: one ends where the
automaton's state has the phrase's state among its suffixes.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwatch.llm.tables import once, per_batch, texts_of, utf8

#: words of a match that may be part of a chain; words that may lie between two matches, in the file and in the template
MATCH, GAP = 4, 12
#: share of a template's words that a span covers at least
COVERED = 0.75

# fixed values: phrases with their labels
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# fixed values: notices and short licences as they are published, by SPDX identifier
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public
License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("gpl-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program
is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the
names of its contributors may be used to endorse or promote products derived from this software without specific prior written
permission."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)

#: A-Z to a-z; all other characters below 128 but digits and letters part words
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Automaton:
    """Generalised suffix automaton of the templates' and phrases' words."""

    def __init__(self, templates, phrases):
        self.templates = [(label, words_of(text.encode())) for label, text in templates]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.numbers: dict[bytes, int] = {}
        ends = defaultdict(list)
        for t, (_, words) in enumerate(self.templates):
            last = 0
            for i, word in enumerate(words):
                last = self._extend(last, self.numbers.setdefault(word, len(self.numbers)))
                ends[last].append((t, i + 1))
        phrase_ids = []
        for phrase, label in phrases.items():
            last, ids = 0, [self.numbers.setdefault(w, len(self.numbers)) for w in words_of(phrase.encode())]
            for i in ids:
                last = self._extend(last, i)
            phrase_ids.append((ids, label))
        #: runs of one word are of no use unless a phrase has one word
        self.least = min([2, *(len(ids) for ids, _ in phrase_ids)])
        # a state's places are its own and those of the longer states that it is a suffix of
        self.places: list[list[tuple[int, int]]] = [ends.get(s, []) for s in range(len(self.link))]
        by_length = sorted(range(1, len(self.link)), key=self.longest.__getitem__)
        for s in reversed(by_length):
            if self.link[s]:
                self.places[self.link[s]] = self.places[self.link[s]] + self.places[s]
        self.phrases: list[tuple[tuple[int, str], ...]] = [()] * len(self.link)
        own = defaultdict(list)
        for ids, label in phrase_ids:
            state = 0
            for i in ids:
                state = self.next[state][i]
            own[state].append((len(ids), label))
        for s in by_length:
            self.phrases[s] = self.phrases[self.link[s]] + tuple(own.get(s, ()))

    def _state(self, longest: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.longest.append(longest)
        return len(self.link) - 1

    def _split(self, before: int, word: int) -> int:
        """The state of the word after ``before``, cut off from longer runs that share it."""
        after = self.next[before][word]
        if self.longest[after] == self.longest[before] + 1:
            return after
        copy = self._state(self.longest[before] + 1)
        self.next[copy], self.link[copy] = dict(self.next[after]), self.link[after]
        self.link[after] = copy
        while before >= 0 and self.next[before].get(word) == after:
            self.next[before][word] = copy
            before = self.link[before]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, before = self._state(self.longest[last] + 1), last
        while before >= 0 and word not in self.next[before]:
            self.next[before][word] = new
            before = self.link[before]
        self.link[new] = self._split(before, word) if before >= 0 else 0
        return new

    def stream(self, words: list[bytes]):
        """(end, length, state) after each word where a run of ``least`` template words or more ends: its matching statistics."""
        number, following, link, longest = self.numbers.get, self.next, self.link, self.longest
        state = length = 0
        for end, word in enumerate(map(number, words), 1):
            if word is None:
                state = length = 0
                continue
            to = following[state].get(word)
            while to is None:  # the root knows every word of a template
                state = link[state]
                length = longest[state]
                to = following[state].get(word)
            state, length = to, length + 1
            if length >= self.least:
                yield end, length, state

    def scan(self, words: list[bytes]):
        """Phrase places (start, label), and matches (end, length, state) of MATCH words or more that no next word extends."""
        found, matches, held = [], [], None
        for end, length, state in self.stream(words):
            for size, label in self.phrases[state]:
                if size <= length:
                    found.append((end - size, label))
            if held and not (end == held[0] + 1 and length == held[1] + 1):
                matches.append(held)
                held = None
            if length >= MATCH:
                held = end, length, state
        if held:
            matches.append(held)
        return found, matches


def automaton(templates=TEMPLATES, phrases=None) -> Automaton:
    phrases = PHRASES if phrases is None else phrases
    return once(("licences", tuple(templates), tuple(phrases.items())), lambda: Automaton(templates, phrases))


class Chain:
    __slots__ = ("start", "end", "first", "last", "covered")

    def __init__(self, start, end, first, last, covered):
        self.start, self.end, self.first, self.last, self.covered = start, end, first, last, covered


def chains(book: Automaton, matches) -> list[tuple[int, Chain]]:
    """(template, chain) of the chains that no later match extends, for each template by the order of their ends.

    A match extends the chain that covers most among those that end at most GAP words before it, in the file and in the
    template, after the words that both have in common are counted once.
    """
    open_: dict[int, list[Chain]] = defaultdict(list)
    out = []
    for end, length, state in matches:
        for t, last in book.places[state]:
            near, best = [], None
            for c in open_[t]:
                if end - length - c.end > GAP:
                    out.append((t, c))
                    continue
                near.append(c)
                cut = max(0, c.end - (end - length), c.last - (last - length))
                if cut < length and last - length + cut - c.last <= GAP and end - length + cut - c.end <= GAP:
                    covered = c.covered + length - cut
                    if covered > length and (best is None or covered > best.covered):
                        best = Chain(c.start, end, c.first, last, covered)
            near.append(best or Chain(end - length, end, last - length, last, length))
            open_[t] = near
    return out + [(t, c) for t, rest in open_.items() for c in rest]


def spans_of(book: Automaton, matches) -> list[tuple]:
    """(label, start, end, template, template start, template end, covered words, share covered), by start: of chains that share words of the file the one
    that covers most words stays, then the one that covers most of its template."""
    found = []
    for t, c in chains(book, matches):
        label, words = book.templates[t]
        found.append((label, c.start, c.end, t, c.first, c.last, c.covered, c.covered / len(words)))
    found.sort(key=lambda s: (-s[6], -s[7], s[1], s[0], s[3], s[4]))
    taken: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by stretches of the file, so that few are compared
    out = []
    for s in found:
        cells = range(s[1] >> 8, (s[2] >> 8) + 1)
        if any(b < s[2] and s[1] < e for cell in cells for b, e in taken[cell]):
            continue
        for cell in cells:
            taken[cell].append((s[1], s[2]))
        out.append(s)
    return sorted(out, key=lambda s: s[1:3])


_SPAN = "struct<label: string, start: long, end: long, template: int, first: long, last: long, covered: long, share: double>"


def license_spans(docs: DataFrame, templates=TEMPLATES, phrases=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, ``places`` of phrases (start, label) and ``spans`` of templates, places in words from 0, ends exclusive.

    A span is a chain of matches; first and last are its place in the template, ``share`` the part of the template's
    words that it covers. Spans of one file do not overlap. A NULL, empty or wordless text has neither places nor spans;
    rows that repeat and NULL ids are kept; an empty table gives no rows; other columns play no part.
    """
    rows = texts_of(docs, id_col, text_col)
    phrases = PHRASES if phrases is None else phrases
    place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    whole = [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("template", pa.int32()), ("first", pa.int64()),
             ("last", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]

    def step(batch):
        book, sizes, places, spans = automaton(templates, phrases), [], [], []
        for text in utf8(batch["text"]):
            words = words_of(text)
            found, matches = book.scan(words)
            sizes.append(len(words))
            places.append([{"start": s, "label": label} for s, label in found])
            spans.append([dict(zip((n for n, _ in whole), s)) for s in spans_of(book, matches)] if matches else [])
        return {"doc_id": batch["doc_id"], "n_words": pa.array(sizes, pa.int64()), "places": pa.array(places, place),
                "spans": pa.array(spans, pa.list_(pa.struct(whole)))}

    return per_batch(rows, step, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, "
                                 f"places array<struct<start: long, label: string>>, spans array<{_SPAN}>", rows=500)


def digests(found: DataFrame, covered: float = COVERED) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (those of phrases and of spans that cover enough), and
    score, the largest share of a template that a span covers (0 without a span)."""
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p.label)))
    more = F.transform(F.filter("spans", lambda s: s.share >= covered), lambda s: s.label)
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").start.alias("first_word"),
        F.array_max("places").start.alias("last_word"), F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.share)), F.lit(0.0)).alias("score"))
