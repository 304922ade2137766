"""Licence scans with a generalised suffix automaton of licence texts.

One automaton holds all templates, word by word. A document's words are streamed through it: at
each word it knows the longest run of words ending there that stands in some template (the
matching statistics). Runs that cannot grow are matches; the best chain of matches that follow
each other in the text as in a template, with small gaps, is a span, and a span that covers
enough of its template names its licence. Changed words, left-out clauses and line
breaks thus cost coverage but do not hide a licence. Whole phrases that count wherever they
stand are states of the same automaton.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanfate.llm.common import in_batches, slices, text_or_empty

# Phrases whose words, standing together, name a licence by themselves.
BASE_PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

# Wordings of public licences and of notices that point to them.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction, including without limitation the rights to "
            "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                 "http://www.apache.org/licenses/LICENSE-2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
             "published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]

#: Words of a match at least, and words of a gap between chained matches at most.
LEAST_MATCH, MOST_GAP = 3, 10
#: Share of a template's words that a span covers at least.
LEAST_SHARE = 0.7

#: Bytes as words see them: A-Z in lower case; digits, a-z and all of other scripts as they are; else a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split()


@dataclass
class _State:
    length: int
    link: int
    next: dict[int, int] = field(default_factory=dict)
    #: Where the state's runs end, by template: all such places.
    ends: dict[int, set[int]] = field(default_factory=dict)
    #: Phrases that end here: (length, label), the state's own and those of its suffixes.
    phrases: tuple = ()


class LicenceAutomaton:
    """Suffix automaton of all templates and phrases, each added from the root."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]) -> None:
        self.labels = [label for label, _ in templates]
        texts = [words_of(text) for _, text in templates]
        named = [(label, words_of(text)) for label, text in phrases.items()]
        self.sizes = [len(t) for t in texts]
        self.vocabulary: dict[bytes, int] = {}
        for words in [*texts, *(w for _, w in named)]:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.states = [_State(0, -1)]
        for k, words in enumerate(texts):
            self._add(words, k)
        for _, words in named:
            self._add(words, None)
        own: dict[int, list[tuple[int, str]]] = {}
        for label, words in named:
            at = 0
            for w in words:
                at = self.states[at].next[self.vocabulary[w]]
            own.setdefault(at, []).append((len(words), label))
        for at in sorted(range(1, len(self.states)), key=lambda v: -self.states[v].length):
            state = self.states[at]
            for k, ends in state.ends.items():
                self.states[state.link].ends.setdefault(k, set()).update(ends)
        for at in sorted(range(1, len(self.states)), key=lambda v: self.states[v].length):
            state = self.states[at]
            state.phrases = tuple(own.get(at, ())) + self.states[state.link].phrases
        self.shortest = min([LEAST_MATCH, *(len(w) for _, w in named)])

    def _add(self, words: list[bytes], template: int | None) -> None:
        last = 0
        for end, w in enumerate(words, 1):
            last = self._extend(last, self.vocabulary[w])
            if template is not None:
                self.states[last].ends.setdefault(template, set()).add(end)

    def _extend(self, last: int, symbol: int) -> int:
        states = self.states
        known = states[last].next.get(symbol)
        if known is not None:
            if states[known].length == states[last].length + 1:
                return known
            return self._clone(last, symbol, known)
        new = len(states)
        states.append(_State(states[last].length + 1, 0))
        at = last
        while at >= 0 and symbol not in states[at].next:
            states[at].next[symbol] = new
            at = states[at].link
        if at >= 0:
            known = states[at].next[symbol]
            states[new].link = known if states[known].length == states[at].length + 1 else self._clone(at, symbol, known)
        return new

    def _clone(self, at: int, symbol: int, known: int) -> int:
        """A state for the runs through ``at`` only, which end at more places than the others of ``known``."""
        states = self.states
        copy = len(states)
        states.append(_State(states[at].length + 1, states[known].link, dict(states[known].next)))
        states[known].link = copy
        while at >= 0 and states[at].next.get(symbol) == known:
            states[at].next[symbol] = copy
            at = states[at].link
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int]], list[tuple[int, int, int]]]:
        """(places of phrases as (label, first word), matches as (first word, words, state))."""
        states, places, matches = self.states, [], []
        ids = list(map(self.vocabulary.get, words))
        at = length = 0
        before = -2
        for i in [i for i, a in enumerate(ids) if a is not None]:
            if i != before + 1:
                if length >= LEAST_MATCH:
                    matches.append((before + 1 - length, length, at))
                at = length = 0
            symbol = ids[i]
            if symbol not in states[at].next:
                if length >= LEAST_MATCH:
                    matches.append((i - length, length, at))
                while at and symbol not in states[at].next:
                    at = states[at].link
                    length = states[at].length
            at = states[at].next[symbol]
            length += 1
            before = i
            if length >= self.shortest:
                places += [(label, i + 1 - n) for n, label in states[at].phrases if n <= length]
        if length >= LEAST_MATCH:
            matches.append((before + 1 - length, length, at))
        return places, matches

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int, float]]:
        """(label, first word, words, covered words, share of the template) of chained matches that cover enough.

        A match stands at one or more places of a template. For each of them the best chain that ends
        there is found over those before it: they start and end earlier both in the text and in the
        template, and end at most :data:`MOST_GAP` words before it in the text. A chain may pass
        matches over. Of the chains that overlap in the text the one that covers most counts, the
        shortest and then the first of equals.
        """
        chains: dict[int, list[tuple[int, int, int, int, int, int]]] = {}  # template: (first, end, template first and end, covered, chain's first)
        live: dict[int, list[tuple]] = {}
        for first, length, state in matches:
            end = first + length
            for k, places in self.states[state].ends.items():
                near = [c for c in live.get(k, ()) if first - c[1] <= MOST_GAP]
                fresh = []
                for t_end in places:
                    t_first, covered, start = t_end - length, length, first
                    for c in near:
                        if c[0] < first and c[1] < end and c[2] < t_first and c[3] < t_end:
                            # Words that both matches hold, in the text or in the template, count once.
                            sum_of_both = c[4] + max(0, length - max(0, c[1] - first, c[3] - t_first))
                            if (sum_of_both, c[5]) > (covered, start if covered > length else -1):
                                covered, start = sum_of_both, c[5]
                    fresh.append((first, end, t_first, t_end, covered, start))
                live[k] = near + fresh
                chains.setdefault(k, []).extend(fresh)
        found = []
        for k, ends in chains.items():
            enough = sorted((-covered, end - start, start) for _, end, _, _, covered, start in ends if covered >= LEAST_SHARE * self.sizes[k])
            taken: list[tuple[int, int]] = []
            for covered, words, start in enough:
                if all(start >= b or start + words <= a for a, b in taken):
                    taken.append((start, start + words))
                    found.append((self.labels[k], start, words, -covered, min(1.0, -covered / self.sizes[k])))
        return sorted(found, key=lambda s: (s[1], s[0], s[2]))


_AUTOMATA: dict[tuple, LicenceAutomaton] = {}


def automaton(templates: list[tuple[str, str]], phrases: dict[str, str]) -> LicenceAutomaton:
    """Made once in each Python worker."""
    key = (tuple(templates), tuple(phrases.items()))
    if key not in _AUTOMATA:
        _AUTOMATA[key] = LicenceAutomaton(templates, phrases)
    return _AUTOMATA[key]


SCAN_DDL = (
    "doc_id long, n_words long, places array<struct<label: string, word: long>>, "
    "spans array<struct<label: string, word: long, words: long, covered: long, share: double>>"
)


def scan_documents(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None
) -> DataFrame:
    """(doc_id, n_words, places, spans) of each whole text; words are counted from 0.

    ``places`` are all places of the phrases, ``spans`` the covered template spans, see
    :meth:`LicenceAutomaton.spans` for ties. A null or empty text has none; a very long one is
    streamed whole. Rows stay as they are, repeats and null ids included, and no rows give no rows.
    Other columns are not read. No shuffle.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = BASE_PHRASES if phrases is None else phrases
    place = pa.struct([("label", pa.string()), ("word", pa.int64())])
    span = pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(place)), ("spans", pa.list_(span))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = automaton(templates, phrases)

        def row(doc_id: int | None, text: str) -> tuple:
            words = words_of(text)
            places, matches = scanner.scan(words)
            spans = scanner.spans(matches) if matches else []
            names = ("label", "word", "words", "covered", "share")
            return doc_id, len(words), [{"label": a, "word": i} for a, i in places], [dict(zip(names, s)) for s in spans]

        for batch in slices(batches, 1024):
            yield from in_batches(map(row, batch.column(0).to_pylist(), batch.column(1).to_pylist()), schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(run, SCAN_DDL)


def summarise(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of scanned documents.

    ``labels`` joins the phrases' labels with those of the spans. The score is the greatest
    covered share, one where a phrase stands whole, zero where nothing was found.
    """
    def joined(names):
        return F.array_join(F.array_sort(F.array_distinct(names)), ",")

    starts = F.transform("places", lambda p: p["word"])
    base, spans = F.transform("places", lambda p: p["label"]), F.transform("spans", lambda s: s["label"])
    covered = F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, spans)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(covered).alias("score"),
    )
