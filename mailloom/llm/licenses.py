"""License scans: phrases, and license templates with optional and replaceable regions.

A template is written in words with ``[...]`` around an optional region, which may hold others, and ``{n}`` for a replaceable
one of up to n words.
It is compiled into an automaton over tokens: a state for each place in the wording, a transition for each word, and a free
step past an optional region. A text is accepted where its words follow the mandatory wording exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base phrases and their labels, fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
    "are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution"
)
_GNU = "free software you can redistribute it and or modify it under the terms of the gnu"
#: Templates of this library: short notices, and the operative wording of the licenses themselves.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license [version] 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that {6} conditions are met",
    "bsd-2-clause": _BSD,
    "bsd-3-clause": f"{_BSD} [3] neither the name of {{12}} may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc-4.0": "licensed under [the] [creative commons] cc by nc 4 0 [license]",
    "cc-notice": "licensed under [a [new]] creative commons attribution [[non] commercial] [noncommercial] [share alike] [sharealike] [noderivatives] {2} international license",
    "copyright-notice": "copyright [c] {6} all rights reserved",
    "gpl-3.0": "licensed under the gnu general public license [version] 3 [or any later version]",
    "gpl-notice": f"{_GNU} general public license [version {{1}}] as published by the free software foundation",
    "isc": "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl-notice": f"{_GNU} lesser general public license [version {{1}}] as published by the free software foundation",
    "mit": "released under the mit license",
    "mit-full": "permission is hereby granted free of charge to any person obtaining a copy of {8} and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of {8} and associated documentation files",
    "mit-notice": "licensed under the mit license",
    "mpl-2.0": "subject to the terms of the mozilla public license [v] [version] 2 0",
    "spdx": "spdx license identifier",
}
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
ANY = None


@dataclass
class Automaton:
    """Transitions ``steps[state]`` as (word or ANY, next state) and free steps ``skips[state]``; the last state accepts."""

    lead: bytes
    steps: list[list[tuple[bytes | None, int]]] = field(default_factory=lambda: [[]])
    skips: list[list[int]] = field(default_factory=lambda: [[]])

    @classmethod
    def compile(cls, template: str) -> Automaton:
        pieces = re.findall(r"\{\d+\}|[\[\]]|[^\s\[\]{}]+", template.lower())
        depth, first = 0, 0
        for first, piece in enumerate(pieces):  # a region in front cannot decide whether a text is accepted
            depth += (piece == "[") - (piece == "]")
            if not depth and piece[0] not in "]{":
                break
        pieces, lead = pieces[first:], []
        for piece in pieces:
            if piece[0] in "[{":
                break
            lead.append(piece.encode())
        out, opened = cls(b" ".join(lead)), []
        for piece in pieces:
            if piece == "[":
                opened.append(len(out.steps) - 1)
            elif piece == "]":
                start = opened.pop()
                out.skips[start].append(len(out.steps) - 1)
            elif piece[0] == "{":
                for _ in range(int(piece[1:-1])):
                    out._step(ANY, free=True)
            else:
                out._step(piece.encode())
        return out

    def _step(self, word: bytes | None, free: bool = False) -> None:
        at = len(self.steps) - 1
        self.steps.append([])
        self.skips.append([])
        self.steps[at].append((word, at + 1))
        if free:
            self.skips[at].append(at + 1)

    def _closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for to in self.skips[todo.pop()]:
                if to not in out:
                    out.add(to)
                    todo.append(to)
        return out

    def accepts(self, words: list[bytes], start: int) -> int | None:
        """Where the wording that begins at this word ends (the first end), or None."""
        states, last = self._closed({0}), len(self.steps) - 1
        for at in range(start, len(words)):
            states = self._closed({to for s in states for word, to in self.steps[s] if word is ANY or word == words[at]})
            if last in states:
                return at + 1
            if not states:
                return None
        return None


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Words (from 0) at which the phrase stands in words joined, led and followed by one space."""
    out, at = [], joined.find(b" " + phrase + b" ")
    done, words = 0, 0
    while at >= 0:
        words += joined.count(b" ", done, at)
        done = at
        out.append(words)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return out


_RESULT = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
])
_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, start: long, end: long>>"


def scan(text: Column, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> Column:
    """A struct of what a whole text says of its license.

    A-Z are lowered; words are runs of ASCII digits, ASCII letters and everything beyond ASCII. ``n_base`` counts all places
    of the phrases, ``first_word`` and ``last_word`` are the smallest and largest of them (else null). ``labels`` adds those
    of accepted templates; both label columns are distinct, sorted and joined by commas, so repeated wording changes counts
    only. ``matches`` has every accepted place. ``score`` is 1 with a template, 0.5 with phrases only, else 0. A null or
    empty text has no words, and empty labels.
    """
    automata = {label: Automaton.compile(t) for label, t in sorted((TEMPLATES if templates is None else templates).items())}
    wanted = {p.encode(): label for p, label in (PHRASES if phrases is None else phrases).items()}

    def judge(value: bytes) -> dict:
        words = _WORD.findall(value.lower())
        joined = b" " + b" ".join(words) + b" "
        places: list[int] = []
        base = set()
        for phrase, label in wanted.items():
            if found := _places(joined, phrase):
                places += found
                base.add(label)
        matches = []
        for label, automaton in automata.items():
            for start in _places(joined, automaton.lead):
                end = automaton.accepts(words, start)
                if end is not None:
                    matches.append({"label": label, "start": start, "end": end})
        labels = base | {m["label"] for m in matches}
        return {
            "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": 1.0 if matches else 0.5 if base else 0.0,
            "matches": matches,
        }

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([judge(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in texts], _RESULT)

    return F.arrow_udf(run, _SCHEMA)(text)
