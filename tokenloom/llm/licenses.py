"""Operator 4, license scans by template markup.

A template is wording with marked regions: <<beginOptional>> ... <<endOptional>> may be
left out, <<var;most=N>> stands for any N words at most, <<any;a|b|c>> for one of some
wordings. Each template becomes an automaton over words whose other words are mandatory.
A run of a text's words is accepted if it leads through the automaton; candidates start
only where a text has a word pair that a template can start with.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. Defined results:
a null text counts as empty and has no labels; every place counts, also within others and
in repeated rows; an empty table gives an empty result; other columns are left alone."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import Words, map_batches, resident, run_hashes, slices

#: Plain phrases, each the label of its license (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_DISCLAIMER = """this software is provided by <<var;most=12>> as is and any express or implied warranties including but not limited to
the implied warranties of merchantability and fitness for a particular purpose are disclaimed"""
_REDISTRIBUTE = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions
and the following disclaimer <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of
conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""

_GNU = """is free software you can redistribute it and or modify it under the terms of the gnu {kind} public license as published by the
free software foundation either {version} or <<beginOptional>>at your option<<endOptional>> any later version <<var;most=12>> is distributed in the hope that it will be useful but without any
warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {kind} public license for more details"""

#: Templates of notices and of whole licenses: label and marked wording (fixed values).
TEMPLATES = [
    ("mit", "<<any;released|licensed|distributed|available>> under the <<beginOptional>>terms of the<<endOptional>> mit license"),
    ("apache-2", "<<any;released|licensed|distributed|available>> under the <<beginOptional>>terms of the<<endOptional>> apache license version 2 0"),
    ("gpl-2", "under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>as published by the free software foundation <<beginOptional>>either<<endOptional>><<endOptional>> version 2"),
    ("gpl-3", "under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>as published by the free software foundation <<beginOptional>>either<<endOptional>><<endOptional>> version 3"),
    ("lgpl", "under the <<beginOptional>>terms of the<<endOptional>> gnu lesser general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "<<any;released|licensed|distributed>> under <<any;the|a>> <<beginOptional>><<any;2|3|two|three>> clause<<endOptional>> bsd <<beginOptional>>style<<endOptional>> license"),
    ("cc-by-nc", "<<beginOptional>>licensed under<<endOptional>> <<any;cc by nc|creative commons attribution noncommercial>> <<any;2|3|4>> 0"),
    ("cc-by-sa", "<<any;cc by sa|creative commons attribution sharealike>> <<any;2|3|4>> 0"),
    ("cc-by", "<<any;cc by|creative commons attribution>> <<any;2|3|4>> 0"),
    ("cc0", "<<any;cc0 1 0|creative commons zero>>"),
    ("all-rights-reserved", "copyright <<beginOptional>>c<<endOptional>> <<var;most=8>> all rights reserved"),
    (
        "mit",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to
        the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be
        included in all copies or substantial portions of the software <<beginOptional>>the software is provided as is without warranty of any kind<<endOptional>>""",
    ),
    (
        "isc",
        """permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies""",
    ),
    ("bsd-2", f"{_REDISTRIBUTE} {_DISCLAIMER}"),
    (
        "apache-2",
        """licensed under the apache license version 2 0 the license you may not use this <<any;file|work|software|product>> except in compliance with
        the license you may obtain a copy of the license at <<var;most=8>> unless required by applicable law or agreed to in writing software
        distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
        see the license for the specific language governing permissions and limitations under the license""",
    ),
    ("gpl-2", _GNU.format(kind="general", version="version 2 of the license")),
    ("gpl-3", _GNU.format(kind="general", version="version 3 of the license")),
    ("lgpl", _GNU.format(kind="<<any;lesser|library>> general", version="version <<any;2|2 1|3>> of the license")),
    ("agpl-3", _GNU.format(kind="affero general", version="version 3 of the license")),
    (
        "mpl-2",
        """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file
        you can obtain one at <<var;most=8>>""",
    ),
    (
        "unlicense",
        """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
        distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means""",
    ),
    (
        "zlib",
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
        arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications
        and to alter it and redistribute it freely subject to the following restrictions <<beginOptional>>1<<endOptional>> the origin of this software
        must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment
        in the product documentation would be appreciated but is not required <<beginOptional>>2<<endOptional>> altered source versions must be plainly
        marked as such and must not be misrepresented as being the original software <<beginOptional>>3<<endOptional>> this notice may not be removed or
        altered from any source distribution""",
    ),
    (
        "bsl-1",
        """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
        covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works
        of the software and to permit third parties to whom the software is furnished to do so all subject to the following""",
    ),
    ("bsd-3", f"{_REDISTRIBUTE} <<beginOptional>>3<<endOptional>> neither the name of <<var;most=12>> may be used to endorse or promote products derived from this software without specific prior written permission {_DISCLAIMER}"),
]


def wordings(folder: Path = Path(__file__).parent / "wordings") -> list[tuple[str, str]]:
    """Templates of whole license texts (fixed values), a file each with the label as its name."""
    return [(p.name.removesuffix(".txt"), p.read_text(encoding="utf-8")) for p in sorted(folder.glob("*.txt"))]


#: Scores by the strongest evidence: a base phrase, a marked notice, and mandatory wording of so many words.
SCORES = (0.6, 0.8, 1.0)
LONG_WORDS = 25

_MARK = re.compile(r"<<(.*?)>>")
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Automaton:
    """The union of all templates: ``step[state]`` maps a word to next states, ``wild`` has
    the states that any word leads to, ``skip`` the states reached without a word."""

    def __init__(self, templates: list[tuple[str, str, int]]):
        """templates: label, wording, and the number that a match counts as."""
        self.step: list[dict[str, list[int]]] = []
        self.wild: list[list[int]] = []
        self.skip: list[list[int]] = []
        self.ends: dict[int, tuple[str, int]] = {}
        self.start = self._state()
        for label, wording, number in templates:
            at = self._state()
            self.skip[self.start].append(at)
            self.ends[self._compile(wording, at)] = (label, number)
        self.close = [self._closure(s) for s in range(len(self.step))]
        self.first = self.close[self.start]
        pairs = {(a, b) for s in self.first for a, nxt in self.step[s].items() for t in nxt for u in self.close[t] for b in (self.step[u] or [None])} | {(a, None) for s in self.first for a, nxt in self.step[s].items() for t in nxt for u in self.close[t] if self.wild[u] or u in self.ends}
        self.openers: dict[str, set[str] | None] = {}
        for a, b in pairs:  # None: any second word, or none
            if b is None or self.openers.get(a, set()) is None:
                self.openers[a] = None
            else:
                self.openers.setdefault(a, set()).add(b)

    def _state(self) -> int:
        self.step.append({})
        self.wild.append([])
        self.skip.append([])
        return len(self.step) - 1

    def _words(self, text: str, at: int) -> int:
        for w in _WORDS.findall(text.lower()):
            nxt = self._state()
            self.step[at].setdefault(w, []).append(nxt)
            at = nxt
        return at

    def _compile(self, wording: str, at: int) -> int:
        open_: list[int] = []
        for i, part in enumerate(_MARK.split(wording)):
            if i % 2 == 0:
                at = self._words(part, at)
                continue
            kind, _, rest = part.partition(";")
            if kind == "beginOptional":
                open_.append(at)
            elif kind == "endOptional":
                nxt = self._state()
                self.skip[at].append(nxt)
                self.skip[open_.pop()].append(nxt)
                at = nxt
            elif kind == "any":
                nxt = self._state()
                for choice in rest.split("|"):
                    self.skip[self._words(choice, at)].append(nxt)
                at = nxt
            elif kind == "var":
                nxt = self._state()
                for _ in range(int(rest.removeprefix("most="))):
                    self.skip[at].append(nxt)
                    more = self._state()
                    self.wild[at].append(more)
                    at = more
                self.skip[at].append(nxt)
                at = nxt
            else:
                raise ValueError(f"unknown mark <<{part}>>")
        if open_:
            raise ValueError("an optional region has no end")
        return at

    def _closure(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for nxt in self.skip[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)

    def match(self, word_at, begin: int, end: int) -> list[tuple[str, int, int, int]]:
        """(label, number, begin, last + 1) of what is accepted from word ``begin`` on; of each
        template the longest."""
        states, found, at = self.first, {}, begin
        while states and at < end:
            word, nxt = word_at(at), set()
            for s in states:
                for t in (*self.step[s].get(word, ()), *self.wild[s]):
                    nxt |= self.close[t]
            states, at = nxt, at + 1
            for s in states:
                if s in self.ends:
                    found[self.ends[s]] = at
        return [(label, number, begin, stop) for (label, number), stop in found.items()]


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        self.n_base = len(phrases)
        wordings = [(label, text) for text, label in phrases.items()] + templates
        self.automaton = Automaton([(label, text, i) for i, (label, text) in enumerate(wordings)])
        self.long = {i for i, (_, text) in enumerate(wordings) if len(_WORDS.findall(_MARK.sub(" ", text.lower()))) >= LONG_WORDS}
        words = [w.encode() for w in self.automaton.openers]
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words])
        self.opening = np.sort(run_hashes(data, np.cumsum(size) - size, size))

    def scan(self, words: Words) -> list[list[tuple[str, int, int, int]]]:
        """For each text what was found: label, number of the wording, and words from and to,
        counted within the text."""
        out: list[list] = [[] for _ in range(len(words.first) - 1)]
        slot = np.minimum(np.searchsorted(self.opening, words.hashes), len(self.opening) - 1)
        hits = np.flatnonzero(self.opening[slot] == words.hashes)
        texts = np.searchsorted(words.first, hits, side="right") - 1
        word_at = lambda i: words.word(i).decode()
        for i, d in zip(hits.tolist(), texts.tolist(), strict=True):
            begin, end = int(words.first[d]), int(words.first[d + 1])
            seconds = self.automaton.openers.get(word_at(i), set())
            if seconds is None or i + 1 < end and word_at(i + 1) in seconds:
                out[d] += [(label, number, a - begin, b - begin) for label, number, a, b in self.automaton.match(word_at, i, end)]
        return out


FOUND = "doc_id long, n_words long, found array<struct<label: string, base: boolean, long: boolean, first_word: long, end_word: long>>"


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_words and every place found: label, whether by a base phrase, whether by
    a long wording, and the words from first_word up to, not with, end_word."""
    # whole texts are read here, on the driver, and travel with the function
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES + wordings() if templates is None else templates
    key = hash((tuple(phrases.items()), tuple(templates)))
    spans = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("long", pa.bool_()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("found", spans)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = resident(("licenses", key), lambda: Scanner(phrases, templates))
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words = Words(part.column(1))
                found = [[{"label": x, "base": n < scanner.n_base, "long": n in scanner.long, "first_word": a, "end_word": b} for x, n, a, b in sorted(one, key=lambda y: (y[2], y[3], y[1]))] for one in scanner.scan(words)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(words.first), pa.int64()), pa.array(found, spans)], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, FOUND)


def summarize(scanned: DataFrame) -> DataFrame:
    """One row a document: counts, first and last base place, labels, and a score."""
    base = F.filter("found", lambda x: x["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")
    weak, middle, strong = SCORES
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["first_word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.when(F.exists("found", lambda x: x["long"]), strong).when(F.exists("found", lambda x: ~x["base"]), middle).when(F.size("found") > 0, weak).otherwise(0.0).alias("score"),
    )
