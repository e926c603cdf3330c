"""License scans by a generalised suffix automaton of licence tokens.

The automaton holds every substring of all templates and base phrases.  Reading a
document's words gives, at each word, the longest suffix that occurs in a
template (the matching statistic) and its state.  Long matches that can't be
extended are chained per template into spans; a template whose spans cover
enough of it gives its label.  A word of no template puts the automaton back to
its root, so stretches between such words are read side by side.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import bound_batches

#: Phrase and label.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Label, and opening, notice or clause of public licences.
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("apache-2.0", "licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation",
    ),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "mit",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ),
    (
        "apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License",
    ),
    (
        "gpl",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details",
    ),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ),
    (
        "bsd",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    (
        "cc0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    ),
]


@dataclass(frozen=True)
class LicenseConfig:
    least_match: int = 3  # words of a match that is chained
    most_gap: int = 8  # words between chained matches, in the document and in the template
    least_cover: float = 0.8  # share of a template's words that its chain covers
    phrases: dict[str, str] = field(default_factory=lambda: dict(BASE_PHRASES))
    templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES)


def _tokens(text: str) -> list[bytes]:
    raw = K.lowered(np.frombuffer(text.encode(), np.uint8))
    w = K.words(raw, np.array([0, len(raw)]), K.ALNUM_WORDS, hashes=False)
    data = raw.tobytes()
    return [data[s:e] for s, e in zip(w.start.tolist(), w.end.tolist(), strict=True)]


class SuffixAutomaton:
    """Generalised suffix automaton over token numbers; bounded by the templates."""

    def __init__(self, cfg: LicenseConfig):
        self.cfg = cfg
        self.texts = [_tokens(t) for _, t in cfg.templates]
        self.labels = [x for x, _ in cfg.templates]
        self.phrases = [_tokens(p) for p in cfg.phrases]
        self.phrase_labels = list(cfg.phrases.values())
        vocabulary = sorted({w for t in [*self.texts, *self.phrases] for w in t})
        number = {w: i for i, w in enumerate(vocabulary)}
        joined = np.frombuffer(b"".join(vocabulary), np.uint8)
        ends = np.cumsum([len(w) for w in vocabulary])
        hashes = K.range_hash(joined, ends - [len(w) for w in vocabulary], ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.low = np.zeros(1 << 16, bool)
        self.low[(self.hashes & np.uint64(0xFFFF)).astype(int)] = True
        self._next: list[dict[int, int]] = [{}]
        self._len, self._link = [0], [-1]
        #: Where a state's strings end: (template, end) pairs.
        self._ends: list[set[tuple[int, int]]] = [set()]
        for n, text in enumerate(self.texts):
            last = 0
            for i, w in enumerate(text):
                last = self._extend(last, number[w])
                self._ends[last].add((n, i + 1))
        for phrase in self.phrases:
            last = 0
            for w in phrase:
                last = self._extend(last, number[w])
        n_states = len(self._len)
        for s in sorted(range(1, n_states), key=lambda s: -self._len[s]):
            self._ends[self._link[s]] |= self._ends[s]
        self.length = np.array(self._len)
        self.link = np.array(self._link)
        self.next = np.full((n_states, len(vocabulary)), -1, np.int32)
        for s, row in enumerate(self._next):
            for c, t in row.items():
                self.next[s, c] = t
        # Phrases that end every string of a state (inherited), or those from a length on.
        self.phrase_state = []
        for phrase in self.phrases:
            s = 0
            for w in phrase:
                s = self._next[s][number[w]]
            self.phrase_state.append(s)
        self.inherits = np.zeros((len(self.phrases), n_states), bool)
        for p, at in enumerate(self.phrase_state):
            for s in range(1, n_states):
                up = self._link[s]
                while up > 0 and up != at:
                    up = self._link[up]
                self.inherits[p, s] = up == at

    def _extend(self, last: int, c: int) -> int:
        """Add one token after state `last`; returns the state of the longer text."""
        to = self._next[last].get(c)
        if to is not None and self._len[to] == self._len[last] + 1:
            return to
        if to is not None:
            return self._split(last, c, to)
        new = self._add(self._len[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self._next[p]:
            self._next[p][c] = new
            p = self._link[p]
        if p >= 0:
            q = self._next[p][c]
            self._link[new] = q if self._len[q] == self._len[p] + 1 else self._split(p, c, q)
        return new

    def _add(self, length: int, row: dict[int, int], link: int) -> int:
        self._len.append(length)
        self._next.append(row)
        self._link.append(link)
        self._ends.append(set())
        return len(self._len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the shorter strings of q, those reached from p by c."""
        part = self._add(self._len[p] + 1, dict(self._next[q]), self._link[q])
        self._link[q] = part
        while p >= 0 and self._next[p].get(c) == q:
            self._next[p][c] = part
            p = self._link[p]
        return part

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Token number of each word, -1 for a word of no template."""
        out = np.full(len(hashes), -1, np.int32)
        hit = np.flatnonzero(self.low[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[hit]), len(self.hashes) - 1)
        ok = self.hashes[at] == hashes[hit]
        out[hit[ok]] = self.order[at[ok]]
        return out

    def statistics(self, numbers: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, match length) after each word of the stretches; zero elsewhere."""
        state = np.zeros(len(numbers), np.int32)
        match = np.zeros(len(numbers), np.int32)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        s = np.zeros(len(start), np.int64)
        m = np.zeros(len(start), np.int64)
        steps = int(length[0]) if len(length) else 0
        live = np.searchsorted(-length, -np.arange(steps), "left")
        for k in range(steps):
            n = int(live[k])
            c = numbers[start[:n] + k]
            cur, got = s[:n], m[:n]
            lost = np.flatnonzero(self.next[cur, c] < 0)
            while len(lost):
                cur[lost] = self.link[cur[lost]]
                root = cur[lost] < 0
                cur[lost[root]] = 0
                got[lost] = self.length[cur[lost]]
                lost = lost[~root]
                lost = lost[self.next[cur[lost], c[lost]] < 0]
            to = self.next[cur, c]
            s[:n] = np.where(to < 0, 0, to)
            m[:n] = np.where(to < 0, 0, got + 1)
            state[start[:n] + k] = s[:n]
            match[start[:n] + k] = m[:n]
        return state, match

    def spans(self, state: np.ndarray, match: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, first word, end word, share covered) for the chains that cover enough.

        state, match: of the matches that can't be extended, which end before word `at`.
        """
        by: dict[int, list[tuple[int, int, int]]] = {}
        for s, m, e in zip(state.tolist(), match.tolist(), at.tolist(), strict=True):
            for t, end in self._ends[s]:
                by.setdefault(t, []).append((e - m, end - m, m))
        out = []
        for t, hits in sorted(by.items()):
            hits.sort()
            size = len(self.texts[t])
            # Best chain that ends with each hit: words covered, first word.
            best: list[tuple[int, int]] = []
            for i, (d, x, m) in enumerate(hits):
                top = (m, d)
                for j in range(i - 1, -1, -1):
                    d0, x0, m0 = hits[j]
                    if d - d0 > size * 2 + self.cfg.most_gap:
                        break
                    gap, jump = d - d0 - m0, x - x0 - m0
                    over = max(0, -gap, -jump)
                    if over < min(m, m0) and gap <= self.cfg.most_gap and jump <= self.cfg.most_gap:
                        top = max(top, (best[j][0] + m - over, best[j][1]))
                best.append(top)
            done = -1
            for (cover, first), (d, _, m) in sorted(zip(best, hits, strict=True), key=lambda b: (-b[0][0], b[1])):
                if cover >= self.cfg.least_cover * size and first > done:
                    out.append((t, first, d + m, min(1.0, cover / size)))
                    done = d + m
        return out


def _scan(automaton):
    def run(it):
        sa: SuffixAutomaton = automaton.value
        sizes = [len(p) for p in sa.phrases]
        for batch in it:
            for lo, hi, raw, offs in K.row_ranges(batch.column("text")):
                w = K.words(K.lowered(raw), offs, K.ALNUM_WORDS)
                n = hi - lo
                number = sa.numbers(w.hash)
                known = number >= 0
                head = np.zeros(len(number) + 1, bool)
                head[w.first] = True
                begins = known.copy()
                begins[1:] &= ~known[:-1] | head[1:-1]
                start = np.flatnonzero(begins)
                stops = np.append(np.flatnonzero(begins | ~known), len(known))
                length = stops[np.searchsorted(stops, start, "right")] - start
                two = length > 1
                state, match = sa.statistics(number, start[two], length[two])
                owner = lambda at: np.searchsorted(w.first, at, "right") - 1
                count = np.zeros(n, np.int64)
                first = np.full(n, 1 << 62)
                last = np.full(n, -1)
                labels: list[set[str]] = [set() for _ in range(n)]
                base: list[set[str]] = [set() for _ in range(n)]
                best = np.zeros(n)
                for p, size in enumerate(sizes):
                    at = np.flatnonzero(sa.inherits[p][state] | ((state == sa.phrase_state[p]) & (match >= size)))
                    doc = owner(at)
                    np.add.at(count, doc, 1)
                    place = at - size + 1 - w.first[doc]
                    np.minimum.at(first, doc, place)
                    np.maximum.at(last, doc, place)
                    for d in np.unique(doc).tolist():
                        base[d].add(sa.phrase_labels[p])
                # A match can't be extended where the next one isn't longer.
                longer = np.zeros(len(match), bool)
                longer[:-1] = (match[1:] > match[:-1]) & ~head[1:-1]
                ends = np.flatnonzero((match >= sa.cfg.least_match) & ~longer)
                doc = owner(ends)
                found: list[list[dict]] = [[] for _ in range(n)]
                for d in np.unique(doc).tolist():
                    own = ends[doc == d]
                    for t, a, b, cover in sa.spans(state[own], match[own], own + 1 - w.first[d]):
                        labels[d].add(sa.labels[t])
                        best[d] = max(best[d], cover)
                        found[d].append({"label": sa.labels[t], "first_word": a, "end_word": b, "cover": cover})
                none = count == 0
                best = np.maximum(best, np.where(none, 0.0, 0.5))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, n),
                        pa.array(w.counts().astype(np.int64)),
                        pa.array(count),
                        pa.array(first, mask=none),
                        pa.array(last, mask=none),
                        pa.array([",".join(sorted(b)) for b in base]),
                        pa.array([",".join(sorted(b | x)) for b, x in zip(base, labels, strict=True)]),
                        pa.array(best),
                        pa.array(
                            found,
                            pa.list_(
                                pa.struct(
                                    [("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("cover", pa.float64())]
                                )
                            ),
                        ),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return run


def scan_licenses(docs: DataFrame, cfg: LicenseConfig = LicenseConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for each row.

    Base phrases are counted at every place; overlapping places count each.  labels adds
    those of templates that a chain of matches covers; score is the best cover, and 0.5 at
    least with a base phrase.  Defined cases: a null or empty text has no words and no
    labels (empty strings), null first_word and last_word and score 0; a null doc_id stays
    null; repeated rows are returned as often as they occur; an empty table gives an empty
    result; other columns are ignored; a long text is held whole, with some 40 bytes for
    each of its words, by the task that reads it.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(cfg))  # as large as the templates
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        _scan(shared),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label string, first_word long, end_word long, cover double>>",
    )
