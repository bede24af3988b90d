"""Operator 5: licence scan with a generalised suffix automaton of licence tokens.

The automaton accepts every run of consecutive words of every template (licence notices and short
phrases).  A document's words are streamed through it, which gives the matching statistic of each place: the
longest run of template words that ends there.  A phrase stands wherever the statistic's match ends in it.
Maximal matches of ``MIN_MATCH`` words and more are chained, in order in the document and in the template,
to the span that covers most of the template.  Only runs of words that occur in some template are
streamed; any other word resets the automaton anyhow.  One narrow pass.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandflow.llm.common import ALNUM, Words, batches_of, frame, schema_with, table

#: Base phrases and their labels (fixed)
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices of public licences (fixed texts)
NOTICES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "cc-by": """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this
        license, visit http://creativecommons.org/licenses/by/4.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
}

MIN_MATCH = 5
COVERED = 0.6
PIECE_BYTES = 4 << 20


def tokens(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010FFFF]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


class Automaton:
    """Generalised suffix automaton: nxt, link, length per state; ends: (template, end) places of a state's words."""

    def __init__(self, templates: list[list[int]]):
        self.nxt, self.link, self.length = [{}], [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for t, words in enumerate(templates):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].append((t, i + 1))
        for s in sorted(range(1, len(self.nxt)), key=lambda s: -self.length[s]):  # a state's places are its link's too
            if self.link[s] > 0:
                self.ends[self.link[s]] += self.ends[s]
        self.ends = [sorted(set(e)) for e in self.ends]

    def _state(self, length: int, nxt: dict, link: int) -> int:
        self.nxt.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.nxt) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of p's words + w, whose target also stands for longer runs."""
        q = self.nxt[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        c = self._state(self.length[p] + 1, dict(self.nxt[q]), self.link[q])
        self.link[q] = c
        while p >= 0 and self.nxt[p].get(w) == q:
            self.nxt[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        if w in self.nxt[last]:
            return self._split(last, w)
        s, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.nxt[p]:
            self.nxt[p][w] = s
            p = self.link[p]
        if p >= 0:
            self.link[s] = self._split(p, w)
        return s

    def stream(self, words) -> list[tuple[int, int]]:
        """(state, matched length) after each word."""
        out, s, n, nxt, link, length = [], 0, 0, self.nxt, self.link, self.length
        for w in words:
            while s and w not in nxt[s]:
                s = link[s]
                n = length[s]
            if w in nxt[s]:
                s, n = nxt[s][w], n + 1
            else:
                s, n = 0, 0
            out.append((s, n))
        return out


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES):
        texts = [tokens(x) for x in [*phrases, *notices.values()]]
        self.labels = [*phrases.values(), *notices]
        self.n_phrases, self.sizes = len(phrases), [len(t) for t in texts]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.automaton = a = Automaton([[self.vocabulary[w] for w in t] for t in texts])
        # phrases in which a state's words end
        self.phrases_at: list[list[int]] = [[] for _ in a.nxt]
        for t in range(self.n_phrases):
            self.phrases_at[a.stream([self.vocabulary[w] for w in texts[t]])[-1][0]].append(t)
        for s in sorted(range(1, len(a.nxt)), key=lambda s: a.length[s]):  # and those of its suffixes
            self.phrases_at[s] = sorted({*self.phrases_at[s], *self.phrases_at[a.link[s]]})
        hashes = Words(pa.array([" ".join(self.vocabulary)]), ALNUM, fold=True).hashes()
        order = np.argsort(hashes)
        self.keys, self.values = hashes[order], np.arange(len(hashes))[order]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.values[at], -1)

    def run(self, words: list[int], start: int, base: list, matches: dict) -> None:
        """Adds what a run of known words that starts at word ``start`` holds."""
        states = self.automaton.stream(words)
        for i, (s, n) in enumerate(states):
            for t in self.phrases_at[s]:
                if n >= self.sizes[t]:
                    base.append((start + i + 1 - self.sizes[t], t))
            if n >= MIN_MATCH and (i + 1 == len(states) or states[i + 1][1] <= n):  # cannot go on
                for t, end in self.automaton.ends[s]:
                    if t >= self.n_phrases:
                        matches[t].append((start + i + 1 - n, end - n, n))

    def chain(self, t: int, matches: list[tuple[int, int, int]]) -> tuple[float, int, int]:
        """(covered share of template t, first word, end) of the best chain of matches that follow one another in both."""
        matches = sorted(matches)
        best, lo, top = [], 0, (0.0, 0, 0)
        for i, (d, p, n) in enumerate(matches):
            while matches[lo][0] < d - 2 * self.sizes[t]:
                lo += 1
            words, first = n, d
            for j in range(lo, i):
                dj, pj, nj = matches[j]
                # a match may overlap the one before: only its new words count
                cut = max(dj + nj - d, pj + nj - p, 0)
                if dj < d and pj < p and cut < n and best[j][0] + n - cut > words:
                    words, first = best[j][0] + n - cut, best[j][1]
            best.append((words, first))
            top = max(top, (words / self.sizes[t], first, d + n), key=lambda x: (x[0], -x[1]))
        return top


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """docs plus n_words, n_base, first_word, last_word (longs), base_labels, found_labels (sorted arrays), score
    and licence_spans (array of label:first word:end, of notices covered at ``COVERED`` or more).

    docs: text and any other columns, kept; columns with the new names are replaced.  Words: runs of digits, a-z
    (A-Z folded) and characters beyond ASCII.  Null and empty texts: no words, no places (null), no labels, score 0.
    score: 1 where a phrase stands, else the best covered share of a notice.  Equal rows get equal results.
    """
    docs = docs.drop("n_words", "n_base", "first_word", "last_word", "base_labels", "found_labels", "score", "licence_spans")
    schema = schema_with(docs, "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
                               "found_labels array<string>, score double, licence_spans array<string>")

    def go(it):
        scanner = Scanner(phrases, notices)
        shortest = min([2, *scanner.sizes[:scanner.n_phrases]])  # a phrase may be one word
        for b in batches_of(PIECE_BYTES)(it):
            w = Words(frame(b, "text"), ALNUM, fold=True)
            ids = scanner.ids(w.hashes())
            known = ids >= 0
            new = known.copy()
            new[1:] &= ~known[:-1] | (w.doc[1:] != w.doc[:-1])
            stop = known.copy()
            stop[:-1] &= ~known[1:] | (w.doc[1:] != w.doc[:-1])
            begin, end = np.flatnonzero(new), np.flatnonzero(stop) + 1
            long = end - begin >= shortest
            base, matches = defaultdict(list), defaultdict(lambda: defaultdict(list))
            for lo, hi in zip(begin[long].tolist(), end[long].tolist(), strict=True):
                d = int(w.doc[lo])
                scanner.run(ids[lo:hi].tolist(), lo - int(w.first[d]), base[d], matches[d])
            rows = []
            for d, n in enumerate(w.n_words.tolist()):
                at = base.get(d, ())
                labels = {scanner.labels[t] for _, t in at}
                chains = [(t, scanner.chain(t, m)) for t, m in sorted(matches[d].items())] if d in matches else []
                good = [(scanner.labels[t], c) for t, c in chains if c[0] >= COVERED]
                rows.append((n, len(at), min(at)[0] if at else None, max(at)[0] if at else None, sorted(labels),
                             sorted(labels | {x for x, _ in good}), 1.0 if at else min(1.0, max((c[0] for _, c in chains), default=0.0)),
                             [f"{x}:{c[1]}:{c[2]}" for x, c in good]))
            fields = list(schema)[len(b.schema):]
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]],
                                             names=[*b.schema.names, *[f.name for f in fields]])

    return docs.mapInArrow(go, schema)


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of all documents."""
    s = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return s.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                    F.array_join("found_labels", ",").alias("labels"), "score")


QUERIES = {"op5_licences": op5_licences}
ORACLE: dict = {}
