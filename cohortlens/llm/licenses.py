"""Licence scan by template markup.

A template is the wording of a licence or notice in which regions are marked as optional,
``<<beginOptional>>…<<endOptional>>`` (also nested), or as replaceable, ``<<var;words=0-12>>``: any words, so many.
It is compiled into an automaton over words.  A place in a text matches if the automaton accepts the words
that start there: all mandatory wording stands there, exactly and in order.

Besides, fixed phrases are looked up wherever their words stand consecutively.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of public licences and notices.
TEMPLATES = {
    "mit-text": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of
        <<var;words=1-8>> (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
        the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;words=1-20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
        THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """
        Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any
        purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;words=1-20>> DISCLAIMS
        ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL <<var;words=1-20>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
        OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "bsd-text": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: <<var;words=0-1>> Redistributions of source code must retain the
        above copyright notice, this list of conditions and the following disclaimer. <<var;words=0-1>>
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.
        <<beginOptional>><<var;words=0-1>> Neither the name of <<var;words=1-12>> nor the names of its contributors
        may be used to endorse or promote products derived from this software without specific prior written
        permission.<<endOptional>> THIS SOFTWARE IS PROVIDED BY <<var;words=1-20>> "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;words=1-20>> BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
        ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "apache-2.0": """
        Licensed under the Apache License, <<beginOptional>>Version<<endOptional>> 2.0
        <<beginOptional>>(the "License"); you may not use <<var;words=1-6>> except in compliance with the
        License<<endOptional>>""",
    "gpl": """
        <<beginOptional>>This <<var;words=1-3>> is<<endOptional>> licensed under the
        <<beginOptional>>terms of the<<endOptional>> GNU <<beginOptional>>Lesser<<endOptional>>
        <<beginOptional>>Affero<<endOptional>> General Public License<<beginOptional>>, version
        <<var;words=1-1>><<endOptional>>""",
    "gpl-text": """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation<<beginOptional>>, either<<endOptional>>
        version <<var;words=1-2>> of the License""",
    "cc-by": """
        <<beginOptional>>Licensed under<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY
        <<beginOptional>>NC<<endOptional>> <<beginOptional>>SA<<endOptional>>
        <<beginOptional>>ND<<endOptional>> 4.0""",
    "cc-by-nc": """
        CC BY NC <<beginOptional>>SA<<endOptional>> <<beginOptional>>ND<<endOptional>> 4.0""",
    "mit": """
        <<beginOptional>>Released<<endOptional>> <<beginOptional>>Licensed<<endOptional>> under the
        <<beginOptional>>terms of the<<endOptional>> MIT License""",
    "spdx-notice": "SPDX-License-Identifier: <<var;words=1-1>>",
    "all-rights-reserved": "All rights reserved",
}

# Bytes that are no word part become spaces, A-Z become a-z, everything from 128 on stays.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MARKUP = re.compile(r"<<(?:(beginOptional|endOptional)|var;words=(\d+)-(\d+))>>")

#: Most words of a replaceable region.
WIDEST = 64


def words(text: bytes) -> list[bytes]:
    """Lower-cased words: ASCII letters and digits, and all other characters beyond ASCII."""
    return text.translate(_WORDS).split()


@dataclass(frozen=True)
class Automaton:
    """Automaton over words.  ``steps[s]`` maps a word to the next states, ``any_word[s]`` lists those after
    any word, ``free[s]`` those reached without a word; state 0 starts and ``accept`` accepts."""

    steps: tuple[dict[bytes, tuple[int, ...]], ...]
    any_word: tuple[tuple[int, ...], ...]
    free: tuple[tuple[int, ...], ...]
    accept: int
    needed: bytes  # the longest wording that every accepted run contains
    firsts: frozenset[bytes] | None  # words that a run can start with; None if any

    def closure(self, states) -> frozenset[int]:
        found, open_ = set(), list(states)
        while open_:
            state = open_.pop()
            if state not in found:
                found.add(state)
                open_ += self.free[state]
        return frozenset(found)

    def longest(self, text: list[bytes], start: int) -> int:
        """End of the longest accepted run from ``start``, or -1."""
        states, end = self.closure([0]), -1
        for at in range(start, len(text) + 1):
            if self.accept in states:
                end = at
            if at == len(text):
                break
            word = text[at]
            reached = {t for s in states for t in (*self.steps[s].get(word, ()), *self.any_word[s])}
            if not reached:
                break
            states = self.closure(reached)
        return end


def compiled(template: str) -> Automaton:
    """The automaton of a template; raises ValueError on broken markup."""
    steps: list[dict[bytes, tuple[int, ...]]] = [{}]
    any_word: list[tuple[int, ...]] = [()]
    free: list[tuple[int, ...]] = [()]

    def state() -> int:
        steps.append({})
        any_word.append(())
        free.append(())
        return len(steps) - 1

    at, opened, at_text = 0, [], 0
    run: list[bytes] = []
    runs: list[list[bytes]] = []

    def literal(text: str) -> None:
        nonlocal at
        for word in words(text.encode()):
            new = state()
            steps[at][word] = (*steps[at].get(word, ()), new)
            at = new
            if not opened:
                run.append(word)

    for mark in _MARKUP.finditer(template):
        literal(template[at_text : mark.start()])
        at_text = mark.end()
        runs.append(list(run))
        run.clear()
        if mark[1] == "beginOptional":
            opened.append(at)
        elif mark[1] == "endOptional":
            if not opened:
                raise ValueError("endOptional without beginOptional")
            begin, end = opened.pop(), state()
            free[at] += (end,)
            free[begin] += (end,)
            at = end
        else:
            least, most = int(mark[2]), int(mark[3])
            if not least <= most <= WIDEST:
                raise ValueError(f"a replaceable region has at most {WIDEST} words: {mark[0]}")
            places = [at]
            for _ in range(most):
                new = state()
                any_word[places[-1]] += (new,)
                places.append(new)
            end = state()
            for place in places[least:]:
                free[place] += (end,)
            at = end
    literal(template[at_text:])
    runs.append(run)
    if opened:
        raise ValueError("beginOptional without endOptional")
    needed = max((b" ".join(r) for r in runs), key=len)
    if not needed:
        raise ValueError("a template needs mandatory words outside optional regions")
    automaton = Automaton(tuple(steps), tuple(any_word), tuple(free), at, needed, None)
    begin = automaton.closure([0])
    if any(any_word[s] for s in begin):
        return automaton
    firsts = frozenset(w for s in begin for w in steps[s])
    return Automaton(automaton.steps, automaton.any_word, automaton.free, at, needed, firsts)


@cache
def _compiled(templates: tuple[tuple[str, str], ...]) -> dict[str, Automaton]:
    return {name: compiled(text) for name, text in templates}


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Numbers of the words at which ``phrase`` starts; ``joined`` has a space around each word."""
    wanted, found = b" " + phrase + b" ", []
    at, counted, word = joined.find(wanted), 0, 0
    while at >= 0:
        word += joined.count(b" ", counted, at)
        counted = at
        found.append(word)
        at = joined.find(wanted, at + 1)
    return found


def scan(text: bytes | None, phrases: dict[str, str], automata: dict[str, Automaton]) -> dict:
    """What :func:`scanned` returns for one text."""
    found = words(text or b"")
    joined = b" " + b" ".join(found) + b" "
    hits = {label: _places(joined, phrase.encode()) for phrase, label in phrases.items() if phrase.encode() in joined}
    places = [p for at in hits.values() for p in at]
    base = sorted(label for label, at in hits.items() if at)
    matches = []
    for name, automaton in automata.items():
        if b" " + automaton.needed + b" " not in joined:
            continue
        firsts = automaton.firsts
        ended = 0
        for start, word in enumerate(found):
            # Runs of one template don't overlap: the next one starts after the last.
            if start >= ended and (firsts is None or word in firsts):
                end = automaton.longest(found, start)
                if end > start:
                    matches.append({"label": name, "first_word": start, "end_word": end})
                    ended = end
    return {
        "n_words": len(found),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": base,
        "labels": sorted({*base, *(m["label"] for m in matches)}),
        "matches": matches,
        "score": 1.0 if matches else 0.5 if base else 0.0,
    }


_SCANNED = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.list_(pa.string())),
        ("labels", pa.list_(pa.string())),
        (
            "matches",
            pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())])),
        ),
        ("score", pa.float64()),
    ]
)


def scanned(text: Column, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> Column:
    """Struct of what a whole text holds; a null text counts as empty.

    ``n_words``; ``n_base``, ``first_word``, ``last_word``: number, smallest and largest start of the phrases'
    places, counted in words from 0; ``base_labels`` and ``labels``, sorted and distinct, without and
    with those of templates; ``matches``: label, first word and end of each accepted run; ``score``: 1 if a template
    matches, a half if only a phrase stands there, else 0.
    """
    marked = tuple((TEMPLATES if templates is None else templates).items())
    phrases = PHRASES if phrases is None else phrases
    _compiled(marked)  # broken markup is reported here

    @F.arrow_udf(
        "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
        "matches array<struct<label: string, first_word: long, end_word: long>>, score double"
    )
    def scan_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automata = _compiled(marked)
        for batch in batches:
            texts = batch.cast(pa.binary())
            yield pa.array([scan(t.as_py(), phrases, automata) for t in texts], _SCANNED)

    return scan_all(text)
