"""License scans with a generalised suffix automaton of licence tokens (operator 1)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from partgraph.llm.common import ALNUM, documents, hashed_words, text_blocks, with_text, word_hashes

# The phrases and labels of the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Passages of well-known public licences and notices, by label: openings, conditions and disclaimers.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files, to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit-conditions": "The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software",
    "mit-disclaimer": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
    "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
    "THE SOFTWARE",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-text": "you may not use this file except in compliance with the License. You may obtain a copy of the "
    "License at http www apache org licenses LICENSE-2.0",
    "apache-2.0-disclaimer": "Unless required by applicable law or agreed to in writing, software distributed under the "
    "License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License",
    "gpl-notice": "This work is licensed under the GNU General Public License, version",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version",
    "gpl-disclaimer": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
    "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
    "for more details",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program",
    "lgpl-text": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-text": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met",
    "bsd-source-condition": "Redistributions of source code must retain the above copyright notice, this list of conditions "
    "and the following disclaimer",
    "bsd-binary-condition": "Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-name-condition": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
    "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-disclaimer": "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "zlib-text": "This software is provided as-is, without any express or implied warranty. In no event will the authors be "
    "held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, "
    "and to alter it and redistribute it freely, subject to the following restrictions",
    "bsl-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
    "software and accompanying documentation covered by this license",
    "cc0-text": "has waived all copyright and related or neighboring rights to this work",
    "cc-by": "licensed under CC BY 4.0",
    "cc-by-sa": "licensed under CC BY SA 4.0",
    "cc-by-nc": "licensed under CC BY NC 4.0",
    "cc-by-text": "This work is licensed under a Creative Commons Attribution",
    "all-rights-reserved": "All rights reserved",
    "unlicense-text": "This is free and unencumbered software released into the public domain",
}

#: Shorter matches than this many words (or than the template) are chance.
MIN_MATCH = 3
#: A chain counts as the template where it covers this share of its words.
MIN_COVER = 0.8
#: Words of the text that may stand between two matches of a chain.
MAX_GAP = 12

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = str.maketrans({c: c + 32 for c in range(65, 91)})


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_FOLD))


@dataclass
class Automaton:
    """Suffix automaton of several token sequences.

    A state stands for all factors with the same ends; ``ends`` lists those as
    (sequence, place after the factor).
    """

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.step) - 1

    def _split(self, p: int, token: int, wanted: int) -> int:
        """The state after ``token`` from p, made to have length ``wanted``."""
        q = self.step[p][token]
        if self.length[q] == wanted:
            return q
        clone = self._state(wanted, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(token) == q:
            self.step[p][token] = clone
            p = self.link[p]
        return clone

    def add(self, number: int, tokens: list[int]) -> None:
        last = 0
        for at, token in enumerate(tokens):
            if token in self.step[last]:
                last = self._split(last, token, self.length[last] + 1)
            else:
                new = self._state(self.length[last] + 1, {}, 0)
                p = last
                while p >= 0 and token not in self.step[p]:
                    self.step[p][token] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, token, self.length[p] + 1)
                last = new
            self.ends[last].add((number, at + 1))

    def close(self) -> None:
        """Hand the ends of each state up its suffix links; call once, after the last add."""
        for s in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def stream(self, tokens: list[int]):
        """Matching statistics: for each token (state, length of the longest suffix that is a factor)."""
        state = length = 0
        for token in tokens:
            while state and token not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.step[state]:
                state, length = self.step[state][token], length + 1
            else:
                state = length = 0
            yield state, length


class Scanner:
    """The automaton with its vocabulary; built from text, so it is made anew in each task."""

    def __init__(self, base: dict[str, str], templates: dict[str, str]):
        self.labels = [*base.values(), *templates]
        self.n_base = len(base)
        sequences = [words_of(x) for x in (*base, *templates.values())]
        words = sorted({w for s in sequences for w in s})
        ids = {w: i + 1 for i, w in enumerate(words)}
        self.sequences = [[ids[w] for w in s] for s in sequences]
        self.automaton = Automaton()
        for i, s in enumerate(self.sequences):
            self.automaton.add(i, s)
        self.automaton.close()
        #: The least match that counts for each sequence, and for any; the templates' own automata, for their matches.
        self.least = [min(MIN_MATCH, len(s)) for s in self.sequences]
        self.shortest = min([len(s) for s in self.sequences if s], default=1)
        self.shortest = min(self.shortest, MIN_MATCH)
        self.own: dict[int, Automaton] = {}
        for i, s in enumerate(self.sequences[self.n_base :], self.n_base):
            self.own[i] = Automaton()
            self.own[i].add(i, s)
            self.own[i].close()
        # Templates that share with a state's longest factor a suffix that counts.
        a = self.automaton
        self.near: list[frozenset[int]] = [frozenset()] * len(a.step)
        for s in sorted(range(1, len(a.step)), key=a.length.__getitem__):
            here = frozenset(n for n, _ in a.ends[s] if n >= self.n_base and a.length[s] >= self.least[n])
            self.near[s] = here | self.near[a.link[s]]
        raw = "\0".join(words).encode()
        offsets = np.cumsum([0] + [len(w.encode()) + 1 for w in words])
        data = np.frombuffer(raw, np.uint8)
        hashes = word_hashes(data, offsets[:-1], np.append(offsets[1:-1] - 1, len(raw)))
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order + 1
        self.size = len(words) + 1
        # Pairs of words that follow each other in a sequence, and those that are a whole one.
        self.pairs, self.whole_pairs = np.zeros(self.size**2, bool), np.zeros(self.size**2, bool)
        for s in self.sequences:
            for a, b in zip(s, s[1:], strict=False):
                self.pairs[a * self.size + b] = True
                self.whole_pairs[a * self.size + b] |= len(s) == 2

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], 0)

    def runs(self, tokens: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, start, end) of the runs of words that the automaton is walked along.

        A match of two words or more lies in a run of words each of which follows the
        one before in some sequence; between such runs no longest factor is over one
        word. So nothing is lost by leaving out the rest, nor runs that are shorter
        than any match that counts. If a sequence is a single word, the runs of known
        words are walked instead.
        """
        if self.shortest < 2:
            inside = np.concatenate([[False], tokens > 0, [False]])
            begins, stops = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
            inner = first[(first > 0) & (first < len(tokens))]
            inner = inner[inside[inner] & inside[inner + 1]]  # a run does not reach into the next text
            begins[inner] = stops[inner] = True
            starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
        else:
            code = tokens[:-1] * self.size + tokens[1:]
            ok = self.pairs[code]
            inner = first[(first > 0) & (first < len(tokens))]
            ok[inner - 1] = False  # no pair reaches into the next text
            hit = np.flatnonzero(ok)
            if not len(hit):
                return []
            cut = np.flatnonzero(np.diff(hit) > 1) + 1
            starts, ends = hit[np.append(0, cut)], hit[np.append(cut - 1, len(hit) - 1)] + 2
            short = np.append(0, np.cumsum(self.whole_pairs[code] & ok))
            keep = (ends - starts >= MIN_MATCH) | (short[ends - 1] > short[starts])
            starts, ends = starts[keep], ends[keep]
        rows = np.searchsorted(first, starts, "right") - 1
        return list(zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True))

    def scan(self, runs: list[tuple[int, list[int]]]) -> tuple[dict[int, list[int]], list[tuple[str, int, int, float]]]:
        """From (first word, tokens) of one text: places of the base phrases, and template spans."""
        base: dict[int, list[int]] = {}
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for first, tokens in runs:
            regions: list[list] = []
            for at, (state, length) in enumerate(self.automaton.stream(tokens)):
                if length < self.shortest:
                    continue
                for number, size in self._ending(state, length):
                    base.setdefault(number, []).append(first + at + 1 - size)
                if self.near[state]:
                    # Matches that overlap or touch make one region, in which the templates met are followed.
                    if regions and at - length + 1 <= regions[-1][1]:
                        regions[-1][1] = at + 1
                        regions[-1][2] |= self.near[state]
                    else:
                        regions.append([at - length + 1, at + 1, set(self.near[state])])
            for a, b, numbers in regions:
                for number in numbers:
                    found = matches.setdefault(number, [])
                    found += [(first + a + x, t, n) for x, t, n in self._matches(number, tokens[a:b])]
        spans = []
        for number, found in matches.items():
            spans += [(self.labels[number], *span) for span in self.chains(number, sorted(set(found)))]
        return base, sorted(spans, key=lambda x: (x[1], x[0]))

    def _matches(self, number: int, tokens: list[int]) -> list[tuple[int, int, int]]:
        """(place, place in the template, words) of the matches with one template that can't be made longer to the right."""
        out, before, own = [], (0, 0), self.own[number]
        for at, (state, length) in enumerate([*own.stream(tokens), (0, 0)]):
            if length <= before[1] and before[1] >= self.least[number]:
                out += [(at - before[1], end - before[1], before[1]) for _, end in own.ends[before[0]]]
            before = (state, length)
        return out

    def _ending(self, state: int, length: int) -> list[tuple[int, int]]:
        """The base phrases that end with the current match."""
        out = []
        while state > 0:
            for number, end in self.automaton.ends[state]:
                whole = len(self.sequences[number])
                if number < self.n_base and end == whole <= length and self.automaton.length[state] >= whole:
                    if self.automaton.length[self.automaton.link[state]] < whole:
                        out.append((number, whole))
            state = self.automaton.link[state]
            length = self.automaton.length[state] if state > 0 else 0
        return out

    def chains(self, number: int, found: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
        """(first word, word after the last, share covered) of the chains of matches that cover the template.

        A chain takes matches in order of place, text and template both rising, with
        at most MAX_GAP words between; its matches may overlap, and count the words
        that they add. The chain of most words is found by dynamic programming;
        then the matches that lie wholly before and after it are chained alike.
        """
        whole = len(self.sequences[number])
        if sum(n for *_, n in found) < MIN_COVER * whole:
            return []
        best: list[tuple[int, int]] = []  # words of the best chain that ends with each match, and the match before
        low = 0
        longest = max(n for *_, n in found)
        for i, (at, t, n) in enumerate(found):
            while found[low][0] + longest + MAX_GAP < at:
                low += 1
            covered, before = n, -1
            for j in range(low, i):
                x, u, m = found[j]
                if x < at <= x + m + MAX_GAP and u < t and at + n > x + m and t + n > u + m:
                    more = best[j][0] + n - max(0, x + m - at, u + m - t)
                    if more > covered:
                        covered, before = more, j
            best.append((covered, before))
        i = max(range(len(found)), key=lambda i: (best[i][0], -i))
        covered, stop = best[i][0], found[i][0] + found[i][2]
        if covered < MIN_COVER * whole:
            return []
        while best[i][1] >= 0:
            i = best[i][1]
        start = found[i][0]
        left = self.chains(number, [f for f in found if f[0] + f[2] <= start])
        right = self.chains(number, [f for f in found if f[0] >= stop])
        return [*left, (start, stop, min(1.0, covered / whole)), *right]


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,first_word:long,end_word:long,covered:double>>"
)
_SPANS = pa.list_(
    pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.float64())])
)


def scan_licenses(
    docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, str] | None = None
) -> DataFrame:
    """Licence mentions and template spans of each text.

    Words are hashed in blocks, a long text in pieces, and streamed through the
    automaton of all phrases and templates, which gives at every word the longest
    factor that ends there; stretches where that can't reach two words are passed
    over (``Scanner.runs``). labels holds the labels of base phrases found and
    of templates of which a chain of matches covers MIN_COVER; score is the largest
    share covered, at least 0.5 where a base phrase stands. first_word and
    last_word are null without a base phrase. Null and empty texts: no words, no
    labels, score 0. Repeated rows and null doc_ids give a result each; other
    columns are left out; no rows give no rows.
    """
    base, templates = base or BASE, templates or TEMPLATES

    def work(batches):
        scanner = Scanner(base, templates)
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(1)):
                hashes, _, _, first = hashed_words(data, offsets, ALNUM)
                tokens = scanner.tokens(hashes)
                by_row: dict[int, list[tuple[int, list[int]]]] = {}
                for row, x, y in scanner.runs(tokens, first):
                    by_row.setdefault(row, []).append((x - int(first[row]), tokens[x:y].tolist()))
                n = b - a
                cols: list[list] = [[0] * n, [None] * n, [None] * n, [""] * n, [""] * n, [0.0] * n, [[]] * n]
                for row, runs in by_row.items():
                    found, spans = scanner.scan(runs)
                    places = [p for v in found.values() for p in v]
                    named = {scanner.labels[k] for k in found}
                    score = max([0.5 * bool(places), *(s[3] for s in spans)])
                    ends_ = (min(places), max(places)) if places else (None, None)
                    every = sorted(named | {s[0] for s in spans})
                    values = (len(places), *ends_, ",".join(sorted(named)), ",".join(every), min(score, 1.0), spans)
                    for c, v in zip(cols, values, strict=True):
                        c[row] = v
                spans_of = [[dict(zip(("label", "first_word", "end_word", "covered"), s, strict=True)) for s in r] for r in cols[6]]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
                arrays = [batch.column(0).slice(a, n).cast(pa.int64()), pa.array(np.diff(first), pa.int64())]
                arrays += [pa.array(c, k) for c, k in zip(cols[:6], kinds, strict=True)] + [pa.array(spans_of, _SPANS)]
                names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return with_text(docs, "doc_id").mapInArrow(work, SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 1 over all documents."""
    return scan_licenses(documents(spark, sf_dir)).drop("spans")
