"""Licence scan: matching statistics of texts against a suffix automaton of licence words.

All licence texts and phrases go into one generalised suffix automaton over words, whose
states are sets of strings with equal places. A text streams through it word by word; the
state and length it has after a word tell the longest match that ends there, and the state's
suffix links tell the longest one within each licence text and the phrases that end there.
Matches that cannot be extended and are long are chained in the order of text and licence;
a chain that covers enough of a licence is a span of it.

The automaton's size is that of the licence texts (given by the caller, some hundred words
here), whatever the corpus is; it goes to every task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexitally.llm.common import mapped, named, utf8

#: Words of a match that is chained, at least.
LONG = 3
#: Words of a text that may stand between two matches of a chain.
GAP = 8
#: Share of a licence text that a chain must cover to be a span of it.
COVER = 0.8
#: Bytes of a text that are split into words at once.
STEP = 1 << 20
# A-Z read as a-z; ASCII other than letters and digits separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

#: Notices of public licences, as their publishers word them.
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied.",
    ),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    (
        "gpl-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
]


def word_lists(text: bytes, step: int = STEP) -> Iterator[list[bytes]]:
    """The words of a text in order, some at a time."""
    rest = b""
    for at in range(0, len(text), step):
        piece = rest + text[at : at + step].translate(_FOLD)
        rest = b""
        if at + step < len(text):
            cut = piece.rfind(b" ") + 1
            piece, rest = piece[:cut], piece[cut:]
        yield piece.split()


def words(text: str) -> list[bytes]:
    return [w for some in word_lists(text.encode()) for w in some]


@dataclass
class Automaton:
    """Suffix automaton of several word sequences; state 0 is the empty string."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [0])
    size: list[int] = field(default_factory=lambda: [0])

    def _state(self, size: int, step: dict[int, int]) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(0)
        return len(self.size) - 1

    def _redirect(self, at: int, word: int, old: int, new: int) -> None:
        """Let ``at`` and the shorter strings behind it that go to ``old`` go to ``new``."""
        while self.step[at].get(word) == old:
            self.step[at][word] = new
            if not at:
                break
            at = self.link[at]

    def _fitting(self, at: int, word: int) -> int:
        """The state of the string of ``at`` and ``word``, split off where longer strings share it."""
        old = self.step[at][word]
        if self.size[old] == self.size[at] + 1:
            return old
        new = self._state(self.size[at] + 1, dict(self.step[old]))
        self.link[new], self.link[old] = self.link[old], new
        self._redirect(at, word, old, new)
        return new

    def add(self, sequence: Sequence[int]) -> list[int]:
        """Add all substrings of a sequence; gives the states of its beginnings."""
        last, path = 0, []
        for word in sequence:
            if word in self.step[last]:
                last = self._fitting(last, word)
            else:
                new, at = self._state(self.size[last] + 1, {}), last
                while word not in self.step[at]:
                    self.step[at][word] = new
                    if not at:
                        at = -1
                        break
                    at = self.link[at]
                self.link[new] = 0 if at < 0 else self._fitting(at, word)
                last = new
            path.append(last)
        return path

    def find(self, sequence: Sequence[int]) -> int:
        state = 0
        for word in sequence:
            state = self.step[state][word]
        return state


class Licences:
    """Licence texts and phrases, compiled for scanning.

    ``reach`` has, for every state, the licence texts that hold its strings or a suffix of
    them, each with the length of the longest such suffix (0: the whole match) and the places
    in the licence where it ends. ``phrases_at`` has the phrases that are suffixes of its strings.
    """

    def __init__(self, notices: Iterable[tuple[str, str]], phrases: Iterable[tuple[str, str]], long: int = LONG):
        self.long = max(1, long)
        split = [(label, words(text)) for label, text in notices]
        asked = [(label, words(text)) for text, label in phrases]
        self.numbers: dict[bytes, int] = {}
        for _, ws in split + asked:
            for w in ws:
                self.numbers.setdefault(w, len(self.numbers))
        coded = [(label, [self.numbers[w] for w in ws]) for label, ws in split if ws]
        self.notices = [(label, len(ws)) for label, ws in coded]
        self.phrases = [(label, [self.numbers[w] for w in ws]) for label, ws in asked if ws]
        auto = Automaton()
        for _, ws in coded + self.phrases:
            auto.add(ws)
        n = len(auto.size)
        ends: list[dict[int, set[int]]] = [{} for _ in range(n)]
        for k, (_, ws) in enumerate(coded):
            state = 0
            for end, w in enumerate(ws, 1):
                state = auto.step[state][w]
                # the state of a beginning holds it as its longest string's suffix; its links hold the shorter ones
                ends[state].setdefault(k, set()).add(end)
        by_size = sorted(range(1, n), key=auto.size.__getitem__)
        for state in reversed(by_size):
            for k, at in ends[state].items():
                ends[auto.link[state]].setdefault(k, set()).update(at)
        self.reach: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(n)]
        self.phrases_at: list[list[int]] = [[] for _ in range(n)]
        for p, (_, ws) in enumerate(self.phrases):
            self.phrases_at[auto.find(ws)].append(p)
        for state in by_size:
            link = auto.link[state]
            own = [(k, 0, tuple(sorted(at))) for k, at in ends[state].items()]
            mine = {k for k, _, _ in own}
            above = [(k, size or auto.size[link], at) for k, size, at in self.reach[link] if k not in mine] if link else []
            self.reach[state] = own + [x for x in above if x[1] >= self.long]
            self.phrases_at[state] = self.phrases_at[state] + (self.phrases_at[link] if link else [])
        self.step, self.link, self.size = auto.step, auto.link, auto.size
        self.short = min([self.long if self.notices else 1 << 30, *[len(ws) for _, ws in self.phrases]])


class Scan:
    """One text on its way through the automaton."""

    def __init__(self, licences: Licences):
        self.licences = licences
        self.state = self.length = self.n_words = 0
        self.open: dict[int, tuple[int, tuple[int, ...]]] = {}
        #: per licence text: (end in the text, end in the licence, words) of matches that cannot be extended
        self.matches: dict[int, list[tuple[int, int, int]]] = {}
        self.places: list[tuple[str, int]] = []

    def feed(self, some: list[bytes]) -> None:
        """Go on with the next words. Runs of known words too short for any match are skipped."""
        if not some:
            return
        numbers = self.licences.numbers
        ids = np.fromiter(map(numbers.get, some, repeat(-1)), np.int32, len(some))
        edge = np.flatnonzero(np.diff(ids >= 0, prepend=False, append=False))
        begins, ends = edge[::2], edge[1::2]
        # a run at either end may go on in the words before or after these
        wanted = (ends - begins >= self.licences.short) | (begins == 0) | (ends == len(ids))
        if not len(wanted) or begins[0] > 0:
            self.close()
        for a, b in zip(begins[wanted].tolist(), ends[wanted].tolist()):
            self._run(ids[a:b].tolist(), self.n_words + a)
            if b < len(ids):
                self.close(self.n_words + b)
        self.n_words += len(ids)

    def _run(self, ids: list[int], at: int) -> None:
        lic, state, length = self.licences, self.state, self.length
        for word in ids:
            while state and word not in lic.step[state]:
                state = lic.link[state]
                length = lic.size[state]
            state = lic.step[state].get(word, 0)
            length = length + 1 if state else 0
            at += 1
            for p in lic.phrases_at[state]:
                label, ws = lic.phrases[p]
                if length >= len(ws):
                    self.places.append((label, at - len(ws)))
            if self.open or length >= lic.long:
                self._matched(state, length, at)
        self.state, self.length = state, length

    def _matched(self, state: int, length: int, at: int) -> None:
        """Note the matches that the word before ``at`` did not extend."""
        now = {}
        if length >= self.licences.long:
            now = {k: (size or length, ends) for k, size, ends in self.licences.reach[state]}
        for k, (size, ends) in self.open.items():
            if k not in now or now[k][0] != size + 1:
                self.matches.setdefault(k, []).extend((at - 1, end, size) for end in ends)
        self.open = now

    def close(self, at: int | None = None) -> None:
        """The run of known words is over."""
        if self.open:
            self._matched(0, 0, (self.n_words if at is None else at) + 1)
        self.state = self.length = 0

    def spans(self, gap: int, cover: float) -> tuple[list[tuple[str, int, int, float]], float]:
        """Spans (label, first word, word after the last, share covered), and the largest share of any chain."""
        found, most = [], 0.0
        for k, matches in self.matches.items():
            label, size = self.licences.notices[k]
            for covered, first, last in chains(sorted(matches), gap):
                most = max(most, covered / size)
                if covered >= cover * size:
                    found.append((label, first, last, covered / size))
        return sorted(found), most


def chains(matches: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Words covered, first word and word after the last of the best chains that share no match.

    ``matches`` are (end in the text, end in the licence, words), sorted. A match follows
    another if it ends later in both and begins at most ``gap`` words of the text after it; what
    the two share in either is counted once. The chain that covers most comes first, then
    the best of those that end in another match and meet no match of a chain before; ties go to
    the earlier end.
    """
    best, before, window, longest = [], [], 0, max((n for _, _, n in matches), default=0)
    for i, (te, le, n) in enumerate(matches):
        top, back = n, -1
        while matches[window][0] < te - longest - gap:
            window += 1
        for j in range(window, i):
            tp, lp, _ = matches[j]
            if tp >= te or lp >= le or tp < te - n - gap:
                continue
            shared = max(tp - (te - n), lp - (le - n), 0)
            if shared < n and te - n + shared - tp <= gap and best[j] + n - shared > top:
                top, back = best[j] + n - shared, j
        best.append(top)
        before.append(back)
    out, used = [], set()
    for i in sorted(range(len(matches)), key=lambda i: (-best[i], i)):
        path, at = [], i
        while at >= 0 and at not in used:
            path.append(at)
            at = before[at]
        if at >= 0:
            continue
        used.update(path)
        out.append((best[i], matches[path[-1]][0] - matches[path[-1]][2], matches[i][0]))
    return out


PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())])
SPAN = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("first", T.LongType()),
        T.StructField("until", T.LongType()),
        T.StructField("covered", T.DoubleType()),
    ]
)
NEW = [
    T.StructField("n_words", T.LongType()),
    T.StructField("places", T.ArrayType(PLACE)),
    T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("covered", T.DoubleType()),
]


def scan_text(text: bytes, licences: Licences, gap: int = GAP, cover: float = COVER, step: int = STEP) -> tuple:
    """Words, places of phrases, spans of licences and the largest share of a licence in a chain."""
    one = Scan(licences)
    for some in word_lists(text, step):
        one.feed(some)
    one.close()
    return one.n_words, one.places, *one.spans(gap, cover)


def _scanner(licences: Licences, gap: int, cover: float) -> Callable:
    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("until", pa.int64()), ("covered", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            rows = [scan_text(data[a:b].tobytes(), licences, gap, cover) for a, b in zip(offsets[:-1], offsets[1:])]
            out = [
                pa.array([n for n, _, _, _ in rows], pa.int64()),
                pa.array([[{"label": x, "word": w} for x, w in at] for _, at, _, _ in rows], place),
                pa.array([[dict(zip(("label", "first", "until", "covered"), x)) for x in spans] for _, _, spans, _ in rows], span),
                pa.array([most for _, _, _, most in rows], pa.float64()),
            ]
            names = [*batch.schema.names[1:], *[f"new_{i}" for i in range(len(out))]]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *out], names=names)

    return run


def scan(
    docs: DataFrame,
    notices: Iterable[tuple[str, str]] = NOTICES,
    phrases: Iterable[tuple[str, str]] = (),
    text_col: str = "text",
    long: int = LONG,
    gap: int = GAP,
    cover: float = COVER,
) -> DataFrame:
    """All columns with ``n_words``, ``places``, ``spans`` and ``covered``.

    ``notices`` are (label, text) of licences, ``phrases`` (text, label). Words are runs of
    ASCII letters (A-Z read as a-z), digits and characters above 127, numbered from 0 in each text.
    ``places`` lists every word at which a phrase's words stand consecutively, ``spans`` the
    stretches (first word, word after the last) whose chained matches of ``long`` words or more
    cover at least ``cover`` of a licence text, and ``covered`` the largest such share, 0 to 1.
    Null and empty texts have no words, places or spans; rows are scanned one by one, repeated
    ones alike; no row gives none; licences and phrases without words are left out. Columns of
    the input with the new names are replaced. Texts are split piece by piece, so memory follows
    a batch of texts and the matches found in one.
    """
    kept = [c for c in docs.columns if c not in {f.name for f in NEW}]
    run = _scanner(Licences(notices, phrases, long), gap, cover)
    return mapped(docs, [named(text_col).cast("string")], kept, run, NEW)
