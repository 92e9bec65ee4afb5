"""License notices in texts: templates with markup, compiled into token automata.

A template is the wording of a notice with two kinds of marked regions:

- ``<<beginOptional>> ... <<endOptional>>`` may be left out, and may be nested;
- ``<<var;name=N;words=2-12>>`` stands for any 2 to 12 words, and
  ``<<var;name=N;match=a|b c>>`` for one of the listed wordings.

All other words are mandatory and must match exactly and in order, whatever
stands between them and however it is capitalised. All templates share one
position automaton: a state is a word of a template that has just been read, so
a text is read once, word by word, with memory bounded by the templates.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from contentdup.llm.common import slices, texts
from contentdup.ship import ship

# Words, over UTF-8 with A-Z in lower case: ASCII letters and digits, and
# everything beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
# Bytes of a text that are split into words at once.
CHUNK = 1 << 20
ANY = b""

# A match of m mandatory words scores m / (m + DOUBT).
DOUBT = 4

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of public license notices.
_COVERED = "<<var;name=granted;match=licensed|released|distributed|available|published|provided>> under"
_TERMS = "<<beginOptional>>the<<endOptional>> <<beginOptional>>terms of<<endOptional>> <<var;name=article;match=the|a>>"
TEMPLATES = {
    "mit": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of
        <<var;name=what;match=this software and associated documentation files|this software>> (the "Software"), to deal in
        the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial
        portions of the Software. <<beginOptional>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS
        OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        <<var;name=rights;match=noninfringement|non infringement>>. IN NO EVENT SHALL <<var;name=holder;words=1-15>> BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.<<endOptional>>""",
        f"{_COVERED} {_TERMS} <<beginOptional>>expat or<<endOptional>> MIT <<var;name=kind;match=license|licence>>",
    ],
    "apache-2.0": [
        f"""{_COVERED} {_TERMS} Apache <<var;name=kind;match=license|licence>>,
        <<beginOptional>>version<<endOptional>> 2<<beginOptional>>.0<<endOptional>>
        <<beginOptional>>(the "License"); you may not use this <<var;name=what;match=file|work|software>> except in compliance
        with the License. You may obtain a copy of the License at <<var;name=place;words=1-12>>. Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.<<endOptional>>""",
    ],
    "gpl-2.0": [f"{_COVERED} {_TERMS} GNU General Public License, <<beginOptional>>version<<endOptional>> 2"],
    "gpl-3.0": [
        f"{_COVERED} {_TERMS} GNU General Public License, <<beginOptional>>version<<endOptional>> 3",
        """you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
        Free Software Foundation, <<beginOptional>>either<<endOptional>> version 3 of the License""",
    ],
    "lgpl": [
        f"""{_COVERED} {_TERMS} GNU <<var;name=kind;match=lesser|library>> General Public License
        <<beginOptional>>, version <<var;name=number;words=1-2>><<endOptional>>""",
    ],
    "bsd": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted
        <<beginOptional>>provided that the following conditions are met<<endOptional>>""",
        f"{_COVERED} {_TERMS} <<beginOptional>><<var;name=clauses;words=1-3>><<endOptional>> BSD license",
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies""",
    ],
    "mpl-2.0": [
        """subject to the terms of the Mozilla Public License, v<<beginOptional>>ersion<<endOptional>> 2.0""",
        f"{_COVERED} {_TERMS} Mozilla Public License, <<beginOptional>>version<<endOptional>> 2.0",
    ],
    **{
        f"cc-{short.replace(' ', '-')}-4.0": [
            f"{_COVERED} <<beginOptional>>{_TERMS}<<endOptional>> CC {short} 4.0",
            f"{_COVERED} <<beginOptional>>{_TERMS}<<endOptional>> Creative Commons {full} 4.0",
        ]
        for short, full in {
            "by": "Attribution",
            "by sa": "Attribution ShareAlike",
            "by nc": "Attribution <<var;name=nc;match=noncommercial|non commercial>>",
            "by nd": "Attribution <<var;name=nd;match=noderivatives|no derivatives>>",
            "by nc sa": "Attribution <<var;name=nc;match=noncommercial|non commercial>> ShareAlike",
        }.items()
    },
    "cc0-1.0": [f"{_COVERED} <<beginOptional>>{_TERMS}<<endOptional>> <<var;name=name;match=cc0 1 0|creative commons zero>>"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


@dataclass(frozen=True)
class Gap:
    """A replaceable region of ``low`` to ``high`` words."""

    low: int
    high: int


@dataclass(frozen=True)
class Either:
    """A replaceable region that holds one of some wordings."""

    wordings: tuple[tuple[bytes, ...], ...]


def parse_template(template: str) -> list:
    """Words, :class:`Gap`, :class:`Either`, and a list for each optional region."""
    stack: list[list] = [[]]
    for place, part in enumerate(re.split(r"<<(.*?)>>", template)):
        if place % 2 == 0:
            stack[-1] += words_of(part)
            continue
        kind, _, rest = part.partition(";")
        options = dict(option.split("=", 1) for option in rest.split(";") if "=" in option)
        if kind == "beginOptional":
            stack.append([])
        elif kind == "endOptional" and len(stack) > 1:
            region = stack.pop()
            stack[-1].append(region)
        elif kind == "var" and "words" in options:
            low, _, high = options["words"].partition("-")
            stack[-1].append(Gap(int(low), int(high or low)))
        elif kind == "var" and "match" in options:
            stack[-1].append(Either(tuple(tuple(words_of(wording)) for wording in options["match"].split("|"))))
        else:
            raise ValueError(f"unknown or unbalanced markup: <<{part}>>")
    if len(stack) > 1:
        raise ValueError("an optional region is not closed")
    return stack[0]


def mandatory_words(items: list) -> int:
    """Words that no text can leave out and still match."""
    return sum(
        1 if isinstance(item, bytes) else min(map(len, item.wordings)) if isinstance(item, Either) else 0 for item in items
    )


class Automaton:
    """All templates as one position automaton.

    A state is a word of a template; ``follow`` says which states a next word
    leads to. ``ends`` gives the template that may end in a state.
    """

    def __init__(self, templates: list[tuple[str, bool, str]]):
        """``templates``: label, whether it is a base phrase, template."""
        self.labels = [(label, base) for label, base, _ in templates]
        self.scores: list[float] = []
        self._words: list[bytes] = []
        self._next: list[set[int]] = []
        self.ends: dict[int, int] = {}
        starts: set[int] = set()
        for number, (label, _, template) in enumerate(templates):
            items = parse_template(template)
            first, last, empty = self._sequence(items)
            if empty or any(self._words[state] == ANY for state in first):
                raise ValueError(f"a template must begin with a word: {label}")
            starts |= first
            self.ends.update(dict.fromkeys(last, number))
            fixed = mandatory_words(items)
            self.scores.append(fixed / (fixed + DOUBT))
        self.first = self._by_word(starts)
        self.follow = [self._by_word(states) for states in self._next]

    def _by_word(self, states: set[int]) -> dict[bytes, list[int]]:
        found: dict[bytes, list[int]] = {}
        for state in sorted(states):
            found.setdefault(self._words[state], []).append(state)
        return found

    def _state(self, word: bytes) -> tuple[set[int], set[int], bool]:
        self._words.append(word)
        self._next.append(set())
        return {len(self._words) - 1}, {len(self._words) - 1}, False

    def _sequence(self, items) -> tuple[set[int], set[int], bool]:
        """States that can be first and last, and whether there may be none."""
        first, last, empty = set(), set(), True
        for item in items:
            begins, finishes, skipped = self._item(item)
            for state in last:
                self._next[state] |= begins
            first |= begins if empty else set()
            last = finishes | (last if skipped else set())
            empty &= skipped
        return first, last, empty

    def _item(self, item) -> tuple[set[int], set[int], bool]:
        if isinstance(item, bytes):
            return self._state(item)
        if isinstance(item, list):
            first, last, _ = self._sequence(item)
            return first, last, True
        if isinstance(item, Either):
            parts = [self._sequence(wording) for wording in item.wordings]
            return set().union(*(p[0] for p in parts)), set().union(*(p[1] for p in parts)), any(p[2] for p in parts)
        # Each word beyond the least number is optional together with those after it.
        region: list = []
        for place in reversed(range(item.high)):
            region = [ANY, *region] if place < item.low else [[ANY, *region]]
        return self._sequence(region)


class Reading:
    """One text, read piece by piece.

    Where matches of a template end at a word, that with the latest start
    counts; of those with one start, that with the latest end.
    """

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.n_words = 0
        self._active: dict[int, int] = {}  # state to the latest start that led to it
        self._found: dict[tuple[int, int], int] = {}

    def read(self, words: list[bytes]) -> None:
        first, follow, ends = self.automaton.first, self.automaton.follow, self.automaton.ends
        hits = [place for place, word in enumerate(words) if word in first]
        active, at = self._active, 0
        while True:
            if not active:
                hit = bisect_left(hits, at)
                at = hits[hit] if hit < len(hits) else len(words)
            if at >= len(words):
                break
            word = words[at]
            reached: dict[int, int] = {}
            for state, start in active.items():
                steps = follow[state]
                for target in (*steps.get(word, ()), *steps.get(ANY, ())):
                    if reached.get(target, -1) < start:
                        reached[target] = start
            for target in first.get(word, ()):
                reached[target] = self.n_words + at
            latest: dict[int, int] = {}
            for state, start in reached.items():
                template = ends.get(state)
                if template is not None and latest.get(template, -1) < start:
                    latest[template] = start
            at += 1
            for template, start in latest.items():
                self._found[template, start] = self.n_words + at
            active = reached
        self._active = active
        self.n_words += len(words)

    def found(self) -> list[tuple[str, bool, int, int, float]]:
        """Label, base or not, first word, end (exclusive), score; in order."""
        labels, scores = self.automaton.labels, self.automaton.scores
        return sorted((*labels[t], start, end, scores[t]) for (t, start), end in self._found.items())


def read_text(automaton: Automaton, text: str) -> Reading:
    """All words of a text, in pieces that end between words."""
    reading, data, at = Reading(automaton), text.encode().lower(), 0
    while at < len(data):
        gap = _GAP.search(data, min(at + CHUNK, len(data)))
        end = gap.start() if gap else len(data)
        reading.read(_WORD.findall(data, at, end))
        at = end
    return reading


_FOUND = "array<struct<label: string, base: boolean, first_word: bigint, end_word: bigint, score: double>>"


def scan_licenses(
    docs: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None
) -> DataFrame:
    """``doc_id, n_words, found`` for every whole text of ``docs``, one row per
    input row.

    ``found`` lists the places of ``phrases`` (marked ``base``) and the matches
    of ``templates``, both in words counted from 0, sorted by label. A null or
    empty text, or one without words, has no words and finds nothing; a very
    long text is read in pieces and loses nothing. Rows may repeat and
    ``doc_id`` may be null; further columns are ignored; an empty table gives
    no rows. A word between mandatory ones ends a match.
    """
    ship(docs.sparkSession)
    wordings = [(label, True, phrase) for phrase, label in (PHRASES if phrases is None else phrases).items()]
    for label, variants in (TEMPLATES if templates is None else templates).items():
        wordings += [(label, False, template) for template in variants]
    automaton = Automaton(wordings)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct(
            [("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64())]
        )
        names = [kind.field(i).name for i in range(kind.num_fields)]
        for batch in slices(batches):
            readings = [read_text(automaton, text) for text in batch.column("text").to_pylist()]
            counts = pa.array([reading.n_words for reading in readings], pa.int64())
            found = pa.array([[dict(zip(names, f)) for f in reading.found()] for reading in readings], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, found], ["doc_id", "n_words", "found"])

    return texts(docs).mapInArrow(scan, f"doc_id bigint, n_words bigint, found {_FOUND}")
