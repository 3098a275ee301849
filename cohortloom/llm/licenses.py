"""Licence scan with a generalised suffix automaton over licence tokens.

The words of all templates and of the short base phrases go into one suffix automaton. Templates are data: the full
texts in the folder `licences` (a file is a licence, its name the label) and the notices that files carry in their
place. The automaton is built once, on the driver, from templates whose size is checked, and is sent to the tasks as
a broadcast. A text is streamed through it once, which gives at every word the length of the longest run ending there
that occurs in some template (matching statistics). Runs of at least `MIN_RUN` words that can't grow are chained per
template, in order, with gaps of at most `MAX_GAP` words, into spans; a span that covers at least `MIN_COVER` of a
template's words labels the text. Where one template lies whole within another, both label it.

Base places come from the same walk: a phrase ends at a word if the phrase's state is the walk's state (with a long
enough match) or one of its suffix links.

Where a run occurs is kept as a range: occurrences are ordered along the tree of suffix links, so those of a state are
neighbours, and no state holds a set of its own.

Defined results: a null or empty text has no words, no places, empty labels and score 0. Repeated rows are repeated; other
columns of the documents are not read, so their names can't clash.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public notices that files carry in place of the whole text, by label; several of one label are numbered.
NOTICES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit-line": "released under the MIT License",
    "apache-2.0-line": "licensed under the Apache License, Version 2.0",
    "gpl-line": "this work is licensed under the GNU General Public License version 3",
    "cc-by-4.0-line": "this work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0-line": "this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
}
FOLDER = Path(__file__).parent / "licences"
# Most words of all templates: the automaton has at most twice as many states.
MOST_WORDS = 1_000_000

MIN_RUN = 4
MAX_GAP = 8
MIN_COVER = 0.6

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def templates_of(folder: Path = FOLDER) -> dict[str, str]:
    """The licence texts of a folder, by file name, and the notices."""
    return {f.stem: f.read_text(encoding="utf-8") for f in sorted(folder.glob("*.txt"))} | NOTICES


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8").translate(_LOWER))


class SuffixAutomaton:
    """Generalised suffix automaton of several word sequences; `occurrences` are where strings of a state end."""

    def __init__(self, sequences: list[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends = []
        for k, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                ends.append((last, k, at))
        self._order(ends)

    def _order(self, ends: list[tuple[int, int, int]]) -> None:
        """Number the states so that those below a state in the tree of suffix links follow it, and sort the ends so."""
        n = len(self.link)
        below: list[list[int]] = [[] for _ in range(n)]
        for state in range(1, n):
            below[self.link[state]].append(state)
        first, after, number = [0] * n, [0] * n, 0
        stack = [(0, False)]
        while stack:
            state, done = stack.pop()
            if done:
                after[state] = number
                continue
            first[state], number = number, number + 1
            stack.append((state, True))
            stack += [(x, False) for x in below[state]]
        ends.sort(key=lambda e: (first[e[0]], e[1], e[2]))
        self.places = [(k, at) for _, k, at in ends]
        start = [0] * (n + 1)
        for state, _, _ in ends:
            start[first[state] + 1] += 1
        for i in range(n):
            start[i + 1] += start[i]
        self.ranges = [(start[first[s]], start[after[s]]) for s in range(n)]

    def occurrences(self, state: int) -> list[tuple[int, int]]:
        """(sequence, place of the last word) of every occurrence of a state's strings."""
        low, high = self.ranges[state]
        return self.places[low:high]

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, at: int, target: int, word: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while at >= 0 and self.step[at].get(word) == target:
            self.step[at][word] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            target = self.step[last][word]
            return target if self.length[target] == self.length[last] + 1 else self._split(last, target, word)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            target = self.step[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, target, word)
        return new

    def state_of(self, sequence: list[int]) -> int:
        state = 0
        for word in sequence:
            state = self.step[state][word]
        return state


class LicenseScanner:
    def __init__(self, templates: dict[str, str] | None = None, base: dict[str, str] = BASE):
        templates = templates_of() if templates is None else templates
        self.numbers: dict[bytes, int] = {}
        self.names = [re.sub("-(line|notice|grant)$", "", n) for n in templates]
        number = lambda text: [self.numbers.setdefault(w, len(self.numbers)) for w in words_of(text)]
        sequences = [number(t) for t in templates.values()]
        if sum(map(len, sequences)) > MOST_WORDS:
            raise ValueError(f"templates of more than {MOST_WORDS} words")
        phrases = [number(p) for p in base]
        self.sizes = [len(s) for s in sequences]
        self.automaton = a = SuffixAutomaton([*sequences, *phrases])
        self.phrases = [(a.state_of(p), len(p), label) for p, label in zip(phrases, base.values())]
        # Of each state: the phrases that end every string of it, and the one for which the match's length decides.
        self.own: list[list[int]] = [[] for _ in a.link]
        for k, (state, _, _) in enumerate(self.phrases):
            self.own[state].append(k)
        self.up: list[list[int]] = [[] for _ in a.link]
        for state in sorted(range(1, len(a.link)), key=a.length.__getitem__):
            if (link := a.link[state]) > 0:
                self.up[state] = self.up[link] + self.own[link] if self.own[link] else self.up[link]

    def matching_statistics(self, words: list[bytes]) -> list[int]:
        """For every word the length of the longest run ending there that occurs in some template or phrase."""
        a, out, state, length = self.automaton, [], 0, 0
        for n in map(self.numbers.get, words):
            while state and n not in a.step[state]:
                state = a.link[state]
                length = a.length[state]
            state, length = (a.step[state][n], length + 1) if n in a.step[state] else (0, 0)
            out.append(length)
        return out

    def scan(self, text: str) -> dict:
        """Words, base places [(start, label)], spans [(label, start, end, cover)], labels and score of a text."""
        words = words_of(text)
        numbers = self.numbers.get
        known = [(i, n) for i, n in enumerate(map(numbers, words)) if n is not None]
        a, places, runs = self.automaton, [], []
        state = length = 0
        before = -2
        for i, n in known:
            if i != before + 1:
                if length >= MIN_RUN:
                    runs.append((before, length, state))
                state = length = 0
            elif length >= MIN_RUN and n not in a.step[state]:
                runs.append((before, length, state))
            before = i
            while state and n not in a.step[state]:
                state = a.link[state]
                length = a.length[state]
            if n in a.step[state]:
                state, length = a.step[state][n], length + 1
            for k in self.up[state]:
                places.append((i - self.phrases[k][1] + 1, self.phrases[k][2]))
            for k in self.own[state]:
                if length >= self.phrases[k][1]:
                    places.append((i - self.phrases[k][1] + 1, self.phrases[k][2]))
        if length >= MIN_RUN:
            runs.append((before, length, state))
        spans = self._chained(runs)
        labels = {label for _, label in places} | {name for name, _, _, cover in spans if cover >= MIN_COVER}
        score = max([1.0 if places else 0.0, *(cover for *_, cover in spans)])
        return {"words": len(words), "places": places, "spans": spans, "labels": labels, "score": min(1.0, score)}

    def _chained(self, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Runs (last word, length, state) of each template in order of text and template, joined over small gaps."""
        by: dict[int, list[list[int]]] = {}
        done = []

        def close(k: int, chain: list[int]) -> None:
            done.append((self.names[k], chain[0], chain[1], min(1.0, chain[3] / self.sizes[k])))

        for last, length, state in runs:
            nearest: dict[int, int] = {}
            for k, at in self.automaton.occurrences(state):
                if k < len(self.names):
                    chains = by.get(k)
                    want = chains[-1][2] if chains else -1
                    if k not in nearest or (at > want) > (nearest[k] > want) or (at > want) == (nearest[k] > want) and at < nearest[k]:
                        nearest[k] = at
            for k, at in nearest.items():
                chains = by.setdefault(k, [])
                start = last - length + 1
                chain = chains[-1] if chains else None
                if chain and start - chain[1] <= MAX_GAP + 1 and at > chain[2]:
                    chain[3] += min(length, at - chain[2])
                    chain[1], chain[2] = last, at
                else:
                    if chain:
                        close(k, chains.pop())
                    chains.append([start, last, at, length])
        for k, chains in by.items():
            for chain in chains:
                close(k, chain)
        return sorted(done, key=lambda x: (x[1], x[2], x[0]))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


@functools.lru_cache(maxsize=4)
def _scanner(templates: tuple | None, base: tuple | None) -> LicenseScanner:
    return LicenseScanner(None if templates is None else dict(templates), BASE if base is None else dict(base))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """Words, base places, labels, score and covered template spans (label:first word:last word) of every whole text."""
    made = _scanner(templates and tuple(templates.items()), base and tuple(base.items()))
    shared = docs.sparkSession.sparkContext.broadcast(made)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = scanner.scan(text)
                starts = [s for s, _ in found["places"]]
                rows.append((
                    doc, found["words"], len(starts), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted({x for _, x in found["places"]})), ",".join(sorted(found["labels"])), found["score"],
                    ",".join(f"{name}:{s}:{e}" for name, s, e, cover in found["spans"] if cover >= MIN_COVER),
                ))
            columns = list(zip(*rows)) if rows else [[]] * 9
            kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split(" ")[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(apply, SCHEMA)
