"""License scans: a generalised suffix automaton of license texts, matching statistics of files, and chains of matches.

The automaton accepts every stretch of words of every template. A file streams through it once: after each word stands
the longest stretch of template words that ends there, so a match that cannot be continued is maximal. Matches of enough
words are chained per template, in order both in the file and in the template and with small gaps, and a chain covers a
span of the file and a share of the template. Chains that cover enough of a template give its label; names of a few words
must stand as a whole, which the states of the automaton tell.

The automaton grows with the templates alone and is sent to the tasks.
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from . import shared

# The phrases that name a license, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices and names of public licenses, as their users write them, with their labels.
TEMPLATES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license version 2.0": "apache-2.0",
    "mozilla public license version 2.0": "mpl-2.0",
    "eclipse public license": "epl",
    "bsd 2-clause license": "bsd-2-clause",
    "bsd 3-clause license": "bsd-3-clause",
    "cc by-nc": "cc-by-nc",
    "cc by-sa": "cc-by-sa",
    "cc by-nd": "cc-by-nd",
    "cc by 4.0": "cc-by-4.0",
    "cc by-nc 4.0": "cc-by-nc-4.0",
    "cc by-sa 4.0": "cc-by-sa-4.0",
    "creative commons attribution 4.0 international license": "cc-by-4.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions": "mit",
    "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the "
    "license you may obtain a copy of the license at": "apache-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "mpl-2.0",
}

# A match counts from so many words; a gap in a chain has at most so many words on either side. A template of fewer than WHOLE
# words must stand as a whole, of a longer one the share COVERED gives its label.
LEAST, GAP, WHOLE, COVERED = 4, 12, 12, 0.7

_WORD_BYTES = bytes(b if chr(b).isdigit() or chr(b).islower() or b >= 0x80 else ord(chr(b).lower()) if chr(b).isupper() else 32
                    for b in range(128)) + bytes(range(128, 256))


def words(text: str | None) -> list[bytes]:
    """Letters, digits and everything beyond ASCII, A-Z lower-cased; all other characters separate."""
    return (text or "").encode().translate(_WORD_BYTES).split()


@dataclass
class Automaton:
    """A generalised suffix automaton; a state's stretches end at the same places of the templates."""
    templates: list[list[bytes]]
    labels: list[str]
    number: dict[bytes, int] = field(default_factory=dict)
    follow: dict[int, int] = field(default_factory=dict)  # state * width + word -> state
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])  # (template, one past the last word)

    def __post_init__(self):
        for t in self.templates:
            for w in t:
                self.number.setdefault(w, len(self.number) + 1)
        self.width = len(self.number) + 1
        following: list[dict[int, int]] = [{}]
        for t, template in enumerate(self.templates):
            last = 0
            for at, w in enumerate(template):
                last = self._extend(following, last, self.number[w])
                self.ends[last].append((t, at + 1))
        self.follow = {s * self.width + w: to for s, each in enumerate(following) for w, to in each.items()}
        by_length = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        # A state's places are its own and those of all states whose suffix it is.
        for s in reversed(by_length):
            if self.link[s] > 0:
                self.ends[self.link[s]] += self.ends[s]
        # The templates that end with a state's longest stretch as a whole, and those that end inside it.
        self.whole, self.inside = [[] for _ in self.link], [[] for _ in self.link]
        for t, template in enumerate(self.templates):
            state = 0
            for w in template:
                state = self.follow[state * self.width + self.number[w]]
            self.whole[state].append(t)
        for s in by_length:
            self.inside[s] = self.inside[self.link[s]] + self.whole[self.link[s]]
        numbers = [np.array([self.number[w] for w in t]) for t in self.templates]
        pairs = [n[:-1] * self.width + n[1:] for n in numbers]
        self.pairs = np.unique(np.concatenate([*pairs, np.empty(0, np.int64)])).astype(np.int64)
        self.single = np.unique(np.concatenate([*[n for n in numbers if len(n) == 1], np.empty(0, np.int64)])).astype(np.int64)

    def _state(self, following, length: int, link: int, edges: dict[int, int]) -> int:
        following.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(following) - 1

    def _split(self, following, state: int, below: int, word: int) -> int:
        """The state of the longest stretch at ``state`` and ``word``; a copy of ``below`` if that one's is longer."""
        if self.length[below] == self.length[state] + 1:
            return below
        copy = self._state(following, self.length[state] + 1, self.link[below], dict(following[below]))
        self.link[below] = copy
        while state >= 0 and following[state].get(word) == below:
            following[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, following, last: int, word: int) -> int:
        below = following[last].get(word)
        if below is not None:
            return self._split(following, last, below, word)
        fresh, state = self._state(following, self.length[last] + 1, 0, {}), last
        while state >= 0 and word not in following[state]:
            following[state][word] = fresh
            state = self.link[state]
        if state >= 0:
            self.link[fresh] = self._split(following, state, following[state][word], word)
        return fresh

    def matches(self, text: list[bytes]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
        """(one past the last word, words, state) of every match that no following word continues, and (one past the last
        word, template) of every place where a whole template stands.

        A match of two words or more consists of pairs of some template, so only stretches of such pairs are streamed.
        """
        get = self.number.get
        codes = np.fromiter((get(w, 0) for w in text), np.int64, len(text))
        usable = np.zeros(len(codes) + 1, bool)
        if len(codes) > 1 and len(self.pairs):
            known = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
            code = codes[known] * self.width + codes[known + 1]
            known = known[self.pairs[np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)] == code]
            usable[known] = usable[known + 1] = True
        if len(self.single):
            usable[:-1] |= np.isin(codes, self.single)
        edge = np.flatnonzero(np.diff(usable, prepend=False))
        follow, link, length, width = self.follow.get, self.link, self.length, self.width
        maximal, whole = [], []
        for begin, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            state, held = 0, 0
            for at, word in enumerate(codes[begin:end].tolist(), begin):
                to = follow(state * width + word)
                if to is None:
                    if held:
                        maximal.append((at, held, state))
                    while to is None and state > 0:
                        state = link[state]
                        to = follow(state * width + word)
                    held = length[state]
                    if to is None:
                        continue
                state, held = to, held + 1
                if self.inside[state]:
                    whole += [(at + 1, t) for t in self.inside[state]]
                if self.whole[state] and held == length[state]:
                    whole += [(at + 1, t) for t in self.whole[state]]
            if held:
                maximal.append((end, held, state))
        return maximal, whole

    def _span(self, template: int, first: int, end: int, covered: int) -> dict:
        return {"label": self.labels[template], "template": template, "first_word": first, "end_word": end,
                "covered": covered, "share": covered / len(self.templates[template])}

    def scan(self, text: list[bytes]) -> list[dict]:
        """The places of short templates and the spans that chains of matches cover of long ones."""
        maximal, whole = self.matches(text)
        sizes = [len(t) for t in self.templates]
        spans = [self._span(t, end - sizes[t], end, sizes[t]) for end, t in whole if sizes[t] < WHOLE]
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for end, held, state in maximal:
            while state > 0 and held >= LEAST:  # suffixes of the match end at further places of the templates
                low = self.length[self.link[state]]
                for t, place in self.ends[state]:
                    if sizes[t] >= WHOLE:
                        by_template.setdefault(t, []).append((end - held, place - held, held))
                state, held = self.link[state], low
        spans += [s for t, found in by_template.items() for s in self._chains(t, found)]
        return sorted(spans, key=lambda s: (s["first_word"], s["end_word"], s["template"]))

    def _chains(self, template: int, found: list[tuple[int, int, int]]) -> list[dict]:
        """Chains of (place in the text, place in the template, words), best first; of chains with a match in common the best."""
        found = sorted(set(found))
        score, before = [n for *_, n in found], [-1] * len(found)
        starts, longest = [a for a, *_ in found], max(n for *_, n in found)
        for j, (a, b, n) in enumerate(found):
            for i in range(bisect_left(starts, a - GAP - longest), j):
                a0, b0, n0 = found[i]
                # Where the matches overlap, in the text or in the template, the words count once.
                fresh = min(n, a + n - a0 - n0, b + n - b0 - n0)
                if a0 < a and b0 < b and fresh > 0 and a - a0 - n0 <= GAP and b - b0 - n0 <= GAP and score[i] + fresh > score[j]:
                    score[j], before[j] = score[i] + fresh, i
        used, out = [False] * len(found), []
        for j in sorted(range(len(found)), key=lambda j: (-score[j], j)):
            chain = []
            while j >= 0 and not used[j]:
                chain.append(j)
                j = before[j]
            if not chain or j >= 0:
                continue
            for i in chain:
                used[i] = True
            (a, _, _), (z, _, n) = found[chain[-1]], found[chain[0]]
            out.append(self._span(template, a, z + n, score[chain[0]]))
        return out

    def accepted(self, span: dict) -> bool:
        return len(self.templates[span["template"]]) < WHOLE or span["share"] >= COVERED


def automaton(templates: Mapping[str, str] | None = None, phrases: Mapping[str, str] | None = None) -> Automaton:
    """The automaton of texts -> labels; ``phrases`` come first, so their templates are numbered from 0. None: the built-in ones."""
    both = [*(PHRASES if phrases is None else phrases).items(), *(TEMPLATES if templates is None else templates).items()]
    split = [(words(t), label) for t, label in both]
    if any(not t for t, _ in split):
        raise ValueError("a template has no words")
    return Automaton([t for t, _ in split], [label for _, label in split])


_SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("template", T.IntegerType()),
                      T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()),
                      T.StructField("covered", T.LongType()), T.StructField("share", T.DoubleType()),
                      T.StructField("accepted", T.BooleanType())])
_ADDED = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN))]


def scan(df: DataFrame, scanner: Automaton | None = None, text: str = "text") -> DataFrame:
    """The rows of ``df`` with ``n_words`` and ``spans``.

    A span is a chain of matches or the place of a short template: its label, the number of its template, its first word
    and one past its last, how many words of the template it covers, as a number and as a share, and whether that gives
    its label. Template numbers follow the order of the automaton's phrases and templates. A match of nothing but parts of
    short templates is no span. A NULL or empty text has no words and no spans; repeated
    rows are answered each for itself; columns named ``n_words`` or ``spans`` are replaced. Without templates there are no
    spans. A text is scanned in one pass and one task.
    """
    found = automaton() if scanner is None else scanner
    names = [f.name for f in _ADDED]
    rest = df.select(*[f"`{c}`" for c in df.columns if c not in names or c == text])
    kept = [f for f in rest.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *_ADDED])
    arrow = shared.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans = [], []
            for value in batch.column(text):
                split = words(value.as_py())
                sizes.append(len(split))
                spans.append([s | {"accepted": found.accepted(s)} for s in found.scan(split)])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept], pa.array(sizes, pa.int64()), pa.array(spans, arrow.field("spans").type)],
                names=[*[f.name for f in kept], *names])

    return rest.mapInArrow(run, schema)
