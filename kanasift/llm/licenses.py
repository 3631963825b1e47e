"""License scans: a generalised suffix automaton of template tokens gives matching statistics, long matches are
chained into covered spans.

The automaton accepts every run of tokens of every template. Streaming a file through it gives, at each token,
the longest run ending there that some template has. A template's runs of MIN_MATCH tokens or more that cannot
be extended are its anchors; anchors that follow one another in both file and template are chained, and a chain that covers
enough of its template labels the file.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a match from which it is an anchor; shorter templates need a match of their whole length.
MIN_MATCH = 6
#: Tokens that may lie between two anchors of a chain, in file and in template.
MAX_GAP = 12
#: Share of a template's tokens that a chain covers from which it labels a file.
MIN_COVER = 0.6

#: Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: The templates' labels and texts, public licence notices.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8: A-Z in lower case, runs of digits, letters a-z and all beyond ASCII."""
    return _WORD.findall((text or "").encode().lower())


@dataclass
class Automaton:
    """A generalised suffix automaton over token numbers; each template is added from the root on."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])
    labels: list[str] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    texts: list[list[int]] = field(default_factory=list)

    def _new(self, size: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        self.ends.append([])
        return len(self.size) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest run followed by c, which is split off if the state there has longer runs."""
        q = self.step[p][c]
        if self.size[q] == self.size[p] + 1:
            return q
        new = self._new(self.size[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = new
            p = self.link[p]
        return new

    def add(self, label: str, text: str) -> None:
        tokens = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
        self.labels.append(label)
        self.lengths.append(len(tokens))
        self.texts.append(tokens)
        last = 0
        for at, c in enumerate(tokens):
            if c in self.step[last]:
                last = self._split(last, c)
            else:
                new, p = self._new(self.size[last] + 1, {}, 0), last
                while p >= 0 and c not in self.step[p]:
                    self.step[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, c)
                last = new
            self.ends[last].append((len(self.labels) - 1, at + 1))

    def finish(self) -> Automaton:
        """Hands the places where runs end up the suffix links, longest runs first."""
        for s in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] = sorted({*self.ends[self.link[s]], *self.ends[s]})
        return self

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """At each token: (longest run ending there that some template has, its state)."""
        step, link, size = self.step, self.link, self.size
        state = length = 0
        out = []
        for c in tokens:
            if c < 0:
                state = length = 0
            else:
                while state and c not in step[state]:
                    state = link[state]
                    length = size[state]
                if c in step[state]:
                    state = step[state][c]
                    length += 1
                else:
                    state = length = 0
            out.append((length, state))
        return out


def build(templates=None) -> Automaton:
    out = Automaton()
    for label, text in templates or TEMPLATES:
        out.add(label, text)
    return out.finish()


def anchors(auto: Automaton, tokens: list[int], min_match: int) -> dict[int, list[tuple[int, int, int]]]:
    """Of each template, (first in file, first in template, length) of all runs shared that can be extended to neither side.

    A template that is itself part of a longer match has its own run there: suffix links lead from the longest
    run that ends at a token to the shorter ones, and the places that each adds.
    """
    stats = auto.statistics(tokens)
    shortest = min([min_match, *auto.lengths])
    out: dict[int, list[tuple[int, int, int]]] = {}
    for k, (n, state) in enumerate(stats):
        following = tokens[k + 1] if k + 1 < len(tokens) else -1
        seen = None
        while n >= shortest and state > 0:
            for t, end in auto.ends[state]:
                if seen and (t, end) in seen:
                    continue
                if n >= min(min_match, auto.lengths[t]) and (following < 0 or end == auto.lengths[t] or auto.texts[t][end] != following):
                    out.setdefault(t, []).append((k + 1 - n, end - n, n))
            up = auto.link[state]
            if up > 0 and auto.size[up] >= shortest:
                seen = set(auto.ends[state])
            state, n = up, auto.size[up]
    return out


def chains(auto: Automaton, tokens: list[int], at: int, min_match: int, max_gap: int) -> list[tuple[int, int, int, int]]:
    """(template, tokens covered, first, end) of chains of anchors in a run of known tokens that begins at `at`.

    An anchor joins the chain of the largest cover that ends max_gap tokens before it at most, else it begins one.
    Anchors come in order of the file, so a chain that ends farther back is closed and never looked at again.
    """
    out = []
    for t, found in anchors(auto, tokens, min_match).items():
        found.sort()
        open_chains: list[list[int]] = []  # file end, template end, covered, first
        for f, p, n in found:
            best, late = None, False
            for c in open_chains:
                if f - c[0] > max_gap:
                    late = True
                    continue
                # What overlaps the chain's end is cut off the anchor's front.
                cut = max(0, c[0] - f, c[1] - p)
                if cut < n and f + cut - c[0] <= max_gap and p + cut - c[1] <= max_gap and (best is None or c[2] > best[0][2]):
                    best = (c, cut)
            if late:
                out += [(t, c[2], at + c[3], at + c[0]) for c in open_chains if f - c[0] > max_gap]
                open_chains = [c for c in open_chains if f - c[0] <= max_gap]
            if best:
                c, cut = best
                c[:3] = [f + n, p + n, c[2] + n - cut]
            else:
                open_chains.append([f + n, p + n, n, f])
        out += [(t, c[2], at + c[3], at + c[0]) for c in open_chains]
    return out


def scan(auto: Automaton, ws: list[bytes], min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER):
    """(spans, score) of a file's words: spans (label, first word, end word, share of template covered)."""
    known = list(map(auto.vocabulary.get, ws))
    shortest = min(auto.lengths, default=1)
    spans, score = [], 0.0
    places = [k for k, x in enumerate(known) if x is not None]
    # A stretch ends where more unknown words follow than a chain may skip.
    cuts = [0, *(k for k in range(1, len(places)) if places[k] - places[k - 1] > max_gap + 1), len(places)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if j - i >= min(min_match, shortest):
            first, end = places[i], places[j - 1] + 1
            for t, covered, lo, hi in chains(auto, [-1 if x is None else x for x in known[first:end]], first, min_match, max_gap):
                share = covered / auto.lengths[t]
                score = max(score, share)
                if share >= min_cover:
                    spans.append((auto.labels[t], lo, hi, share))
    return sorted(spans, key=lambda s: (s[1], s[2], s[0])), min(1.0, score)


def _phrase_places(ws: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    lasts, out = {p[-1] for p, _ in phrases}, []
    for last in lasts:
        k = -1
        while True:
            try:
                k = ws.index(last, k + 1)
            except ValueError:
                break
            out += [(k + 1 - len(p), label) for p, label in phrases if k + 1 >= len(p) and ws[k + 1 - len(p) : k + 1] == p]
    return sorted(out)


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:int,end:int,cover:double>>"


def scan_documents(docs: DataFrame, templates=None, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER) -> DataFrame:
    """One row for each row of docs (doc_id, text): figures, labels, score and covered template spans.

    Null and empty texts have no words, no places and score 0; repeated rows are scanned each; no rows give no
    rows; other columns are ignored. score is the largest share of a template that a chain covers. Time and memory
    grow with a text's length, whatever notices it repeats.
    """
    templates = list(templates or TEMPLATES)
    phrases = [(words(p), label) for p, label in PHRASES.items()]
    span = pa.struct([("label", pa.string()), ("first", pa.int32()), ("end", pa.int32()), ("cover", pa.float64())])

    def run(batches):
        auto = build(templates)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), (t.as_py() for t in b.column(1)), strict=True):
                ws = words(text)
                places = _phrase_places(ws, phrases)
                spans, score = scan(auto, ws, min_match, max_gap, min_cover)
                base = {label for _, label in places}
                rows.append((doc_id, len(ws), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})), score, [dict(zip(("label", "first", "end", "cover"), s, strict=True)) for s in spans]))
            kinds = (*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64(), pa.list_(span))
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)
