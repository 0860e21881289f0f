"""Licence scan: matching statistics against a generalised suffix automaton of licence tokens.

The automaton holds every run of words of every licence template. A text is streamed through it
once; at each word the automaton knows the longest run that ends there and occurs in a template.
Runs that cannot be extended are chained, template by template, when they follow each other both
in the text and in the template; a template whose words are covered well enough gives its label.

Nothing is shuffled: a text is one row, work is linear in its words, memory is one text plus the
automaton, whose size is that of the template list below.

Null and empty texts have no words: zero counts, null positions, empty labels, score 0. Repeated
rows give repeated results; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from tallymark.llm.common import alnum_words, map_rows

#: The phrases whose places are counted, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Public notices and key sentences by label, in the licences' own words.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software "
        "and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software",
        "released under the mit license",
    ),
    "apache-2": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the "
        "license at http www apache org licenses license 2 0 unless required by applicable law or agreed "
        "to in writing software distributed under the license is distributed on an as is basis",
    ),
    "gpl-2": (
        "gnu general public license version 2",
        "either version 2 of the license or at your option any later version",
    ),
    "gpl-3": (
        "licensed under the gnu general public license version 3",
        "either version 3 of the license or at your option any later version",
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the "
        "gnu general public license as published by the free software foundation",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met redistributions of source code must retain the "
        "above copyright notice this list of conditions and the following disclaimer",
        "released under the bsd license",
    ),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "mozilla public license version 2 0",
    ),
    "cc-by": ("licensed under a creative commons attribution 4 0 international license",),
    "cc-by-nc": (
        "licensed under cc by nc 4 0",
        "creative commons attribution noncommercial 4 0 international license",
    ),
    "cc0": ("cc0 1 0 universal public domain dedication",),
}


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the templates that each state occurs in."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[dict[int, int]] = [{}]
        self.texts: list[list[int]] = []

    def add(self, text: list[int]) -> int:
        """Add a template; its number is returned."""
        number, last = len(self.texts), 0
        self.texts.append(text)
        for at, token in enumerate(text):
            last = self._extend(last, token)
            self.ends[last].setdefault(number, at + 1)
        return number

    def _extend(self, last: int, token: int) -> int:
        known = self.step[last].get(token)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, token, known)
        new = self._state(self.length[last] + 1, {})
        at = last
        while at >= 0 and token not in self.step[at]:
            self.step[at][token] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
            return new
        target = self.step[at][token]
        exact = self.length[target] == self.length[at] + 1
        self.link[new] = target if exact else self._split(at, token, target)
        return new

    def _state(self, length: int, step: dict[int, int]) -> int:
        self.step.append(step)
        self.link.append(0)
        self.length.append(length)
        self.ends.append({})
        return len(self.step) - 1

    def _split(self, at: int, token: int, target: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.step[target]))
        self.link[copy] = self.link[target]
        self.link[target] = copy
        while at >= 0 and self.step[at].get(token) == target:
            self.step[at][token] = copy
            at = self.link[at]
        return copy

    def close(self) -> None:
        """Hand down, from longer to shorter runs, where a run first ends in each template."""
        for state in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            up = self.ends[self.link[state]]
            for number, end in self.ends[state].items():
                if end < up.get(number, end + 1):
                    up[number] = end

    def matches(self, tokens: list[int | None], least: int):
        """(end, length, state) of every run of ``least`` words or more that no further word extends,
        and the statistic at each word through ``self.seen``."""
        step, link, length = self.step, self.link, self.length
        state = run = 0
        for at, token in enumerate(tokens):
            if token is None:
                if run >= least:
                    yield at, run, state
                state = run = 0
                continue
            to = step[state].get(token)
            if to is None:
                if run >= least:
                    yield at, run, state
                while state and to is None:
                    state = link[state]
                    run = length[state]
                    to = step[state].get(token)
                if to is None:
                    run = 0
                    continue
            state = to
            run += 1
        if run >= least:
            yield len(tokens), run, state


class LicenceMatcher:
    """Templates, phrases and the thresholds of the chain."""

    def __init__(self, templates, phrases, least: int, gap: int, coverage: float) -> None:
        self.least, self.gap, self.coverage = least, gap, coverage
        self.ids: dict[bytes, int] = {}
        self.automaton = SuffixAutomaton()
        self.labels: list[str] = []
        for label, texts in templates.items():
            for text in texts:
                self._add(text, label)
        self.phrases: dict[int, tuple[list[int], str]] = {}
        for phrase, label in phrases.items():
            number = self._add(phrase, label)
            self.phrases[number] = (self.automaton.texts[number], label)
        self.automaton.close()

    def _add(self, text: str, label: str) -> int:
        tokens = [self.ids.setdefault(w, len(self.ids)) for w in alnum_words(text)]
        self.labels.append(label)
        return self.automaton.add(tokens)

    def scan(self, text: str | None) -> tuple:
        """(words, places, first, last, base labels, labels, score, spans) of one text."""
        words = alnum_words(text)
        tokens = list(map(self.ids.get, words))
        runs = list(self.automaton.matches(tokens, self.least))
        places, base = self._places(tokens, runs)
        spans, best = self._chains(runs)
        labels = base | {self.labels[number] for number, *_ in spans}
        return (
            len(words),
            len(places),
            min(places, default=None),
            max(places, default=None),
            ",".join(sorted(base)),
            ",".join(sorted(labels)),
            1.0 if base else best,
            spans,
        )

    def _places(self, tokens, runs) -> tuple[list[int], set[str]]:
        """Every start of a phrase. A phrase lies whole in the run that is open at its last word."""
        places: set[tuple[int, int]] = set()
        base: set[str] = set()
        for end, run, _ in runs:
            for number, (phrase, label) in self.phrases.items():
                for at in range(end - run, end - len(phrase) + 1):
                    if tokens[at : at + len(phrase)] == phrase:
                        places.add((at, number))
                        base.add(label)
        return [at for at, _ in places], base

    def _chains(self, runs) -> tuple[list[tuple[int, int, int, float]], float]:
        """(template, first word, end, coverage) where chained runs cover a template well enough.

        A run extends the chain of a template if it starts within ``gap`` words of the chain's end
        and ends later in the template; shared words count once.
        """
        spans: list[tuple[int, int, int, float]] = []
        best = 0.0
        chains: dict[int, list[int]] = {}

        def finish(number: int, chain: list[int]) -> None:
            nonlocal best
            share = min(1.0, chain[3] / len(self.automaton.texts[number]))
            best = max(best, share)
            if share >= self.coverage:
                spans.append((number, chain[0], chain[1], share))

        for end, run, state in runs:
            for number, template_end in self.automaton.ends[state].items():
                if number in self.phrases:
                    continue
                start, chain = end - run, chains.get(number)
                if chain and start - chain[1] <= self.gap and template_end > chain[2]:
                    fresh = min(run, end - chain[1], template_end - chain[2])
                    chain[1], chain[2], chain[3] = end, template_end, chain[3] + max(0, fresh)
                else:
                    if chain:
                        finish(number, chain)
                    chains[number] = [start, end, template_end, run]
        for number, chain in chains.items():
            finish(number, chain)
        return sorted(spans, key=lambda s: (s[1], s[0])), best


@lru_cache(maxsize=8)
def matcher(least: int = 3, gap: int = 8, coverage: float = 0.6) -> LicenceMatcher:
    """Built once in each Python worker from the fixed lists."""
    return LicenceMatcher(TEMPLATES, BASE_PHRASES, least, gap, coverage)


SCHEMA = (
    "{id} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, spans array<struct<label: string, first: long, end: long, "
    "coverage: double>>"
)


def licence_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = 3,
    gap: int = 8,
    coverage: float = 0.6,
) -> DataFrame:
    """One row per text: words, places of the base phrases, labels, and covered template spans.

    ``least``: shortest run in words; ``gap``: most words between runs of a chain; ``coverage``:
    least share of a template's words for its label.
    """

    def work(rows: dict[str, list]) -> dict[str, list]:
        found = matcher(least, gap, coverage)
        scans = [found.scan(text) for text in rows[text_col]]
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
        out = {name: [scan[i] for scan in scans] for i, name in enumerate(names)}
        out[id_col] = rows[id_col]
        out["spans"] = [
            [
                {"label": found.labels[n], "first": first, "end": end, "coverage": share}
                for n, first, end, share in scan[7]
            ]
            for scan in scans
        ]
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], SCHEMA.format(id=id_col, kind=kind), work)
