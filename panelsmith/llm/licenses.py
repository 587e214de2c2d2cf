"""License scans: templates with optional and replaceable regions, compiled into one automaton over words."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.llm.common import small_batches

MENTION, NOTICE, FULL = 0.5, 0.75, 1.0  # how much of a license a template's wording is
_MOVES = 200_000  # transitions that a worker remembers
#: A to Z in lower case; ASCII that is no letter or digit parts words; other characters belong to words
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_MARKUP = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+)-(\d+))>>")
_KINDS = "doc_id long, n_words long, places array<struct<label: string, base: boolean, strength: double, first_word: long, n_words: long>>"

#: fixed values: phrase and label
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_GNU = "gnu {} general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> <<beginOptional>>version<<endOptional>> <<beginOptional>>v<<endOptional>> {}"
_CC = "creative commons attribution {} <<beginOptional>>license<<endOptional>>"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<var;words=0-1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<var;words=0-1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution "
)
#: (label, strength, wording in markup): wording of public licenses, which must match word for word outside its regions
TEMPLATES: tuple[tuple[str, float, str], ...] = (
    ("mit", MENTION, "<<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>expat<<endOptional>> mit license"),
    ("mit", FULL, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software"),
    ("isc", FULL, "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2", MENTION, "licensed under the apache license <<beginOptional>>version<<endOptional>> 2"),
    ("apache-2", NOTICE, "licensed under the apache license version 2 0 <<beginOptional>>the license<<endOptional>> you may not use this <<var;words=1-3>> except in compliance with the license"),
    ("bsd-2-clause", FULL, _BSD + "this software is provided by"),
    ("bsd-3-clause", FULL, _BSD + "<<var;words=0-1>> neither the name of <<var;words=1-20>> nor the names of <<beginOptional>>its<<endOptional>> contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl-2", NOTICE, _GNU.format("", "2")),
    ("gpl-3", NOTICE, _GNU.format("", "3")),
    ("lgpl-2.1", NOTICE, _GNU.format("lesser", "2 1")),
    ("lgpl-3", NOTICE, _GNU.format("lesser", "3")),
    ("agpl-3", NOTICE, _GNU.format("affero", "3")),
    ("mpl-2", NOTICE, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", NOTICE, "this is free and unencumbered software released into the public domain"),
    ("cc0", NOTICE, "creative commons zero <<beginOptional>>public domain dedication<<endOptional>>"),
    ("cc0", MENTION, "cc0 1 0 <<beginOptional>>universal<<endOptional>>"),
    ("cc-by-nc", NOTICE, _CC.format("noncommercial")),
    ("cc-by-nc", MENTION, "<<beginOptional>>licensed<<endOptional>> under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by nc"),
    ("cc-by-sa", MENTION, "<<beginOptional>>creative commons<<endOptional>> cc by sa"),
    ("cc-by-sa", NOTICE, _CC.format("sharealike")),
    ("cc-by-nd", MENTION, "<<beginOptional>>creative commons<<endOptional>> cc by nd"),
    ("zlib", FULL, "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost-1", NOTICE, "distributed under the boost software license version 1 0"),
    ("mit", NOTICE, "spdx license identifier mit"),
    ("apache-2", NOTICE, "spdx license identifier apache 2 0"),
    ("bsd-3-clause", NOTICE, "spdx license identifier bsd 3 clause"),
    ("bsd-2-clause", NOTICE, "spdx license identifier bsd 2 clause"),
    ("gpl-2", NOTICE, "spdx license identifier gpl 2 0"),
    ("gpl-3", NOTICE, "spdx license identifier gpl 3 0"),
)


def words_of(text: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are lower-cased."""
    return text.translate(_WORDS).split()


class TemplateAutomaton:
    """All templates as one automaton over words, made deterministic as it meets words.

    A template is words, ``<<beginOptional>>...<<endOptional>>`` (there as a whole or not at all; may be nested) and
    ``<<var;words=a-b>>`` (a to b words, whatever they are). Its mandatory words must match exactly. A state is a set of places in
    templates; transitions are remembered by state and word, for words of no template by state alone.
    """

    def __init__(self, templates: Sequence[str]):
        self.edges: list[list[tuple[bytes | None, int]]] = []  # of each place: (word or any, next place)
        self.skips: list[list[int]] = []  # places that are reached without a word
        self.ends: dict[int, int] = {}  # the last place of each template
        starts = [self._compile(k, t) for k, t in enumerate(templates)]
        self.known = {w for e in self.edges for w, _ in e if w is not None}
        self._forget()
        self.start = self._state(starts)
        if self.accepts[self.start] or any(w is None for p in self.states[self.start] for w, _ in self.edges[p]):
            raise ValueError("a template must begin with a mandatory word, or an optional region before one")
        self.firsts = {w for p in self.states[self.start] for w, _ in self.edges[p]}

    def _place(self) -> int:
        self.edges.append([])
        self.skips.append([])
        return len(self.edges) - 1

    def _compile(self, number: int, template: str) -> int:
        first = at = self._place()
        opened: list[int] = []
        for k, part in enumerate(re.split(r"(<<.*?>>)", template)):
            if not k % 2:
                for w in words_of(part.encode()):
                    self.edges[at].append((w, to := self._place()))
                    at = to
                continue
            mark = _MARKUP.fullmatch(part)
            if mark is None:
                raise ValueError(f"unknown markup {part}")
            if mark[1] == "beginOptional":
                opened.append(at)
            elif mark[1] == "endOptional":
                if not opened:
                    raise ValueError("an optional region ends that did not begin")
                begin, to = opened.pop(), self._place()
                self.skips[at].append(to)
                self.skips[begin].append(to)
                at = to
            else:
                least, most = int(mark[2]), int(mark[3])
                gaps = []
                for n in range(most):
                    if n >= least:
                        gaps.append(at)
                    self.edges[at].append((None, to := self._place()))
                    at = to
                for g in gaps:
                    self.skips[g].append(at)
        if opened:
            raise ValueError("an optional region does not end")
        self.ends[at] = number
        return first

    def _forget(self) -> None:
        self.states: list[frozenset[int]] = []
        self.places: dict[frozenset[int], int] = {}
        self.accepts: list[tuple[int, ...]] = []
        self.moves: list[dict[bytes | None, int]] = []
        self.size = 0

    def _state(self, places: Sequence[int]) -> int:
        reached, todo = set(places), list(places)
        while todo:
            for q in self.skips[todo.pop()]:
                if q not in reached:
                    reached.add(q)
                    todo.append(q)
        key = frozenset(reached)
        if (at := self.places.setdefault(key, len(self.states))) == len(self.states):
            self.states.append(key)
            self.accepts.append(tuple(sorted({self.ends[p] for p in key if p in self.ends})))
            self.moves.append({})
        return at

    def _move(self, state: int, word: bytes | None) -> int:
        to = [q for p in self.states[state] for w, q in self.edges[p] if w is None or w == word]
        self.moves[state][word] = at = self._state(to) if to else -1
        self.size += 1
        return at

    def match(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word, number of words) of every place where a template matches: the longest match of each template and first word."""
        if self.size > _MOVES:
            first = self.states[self.start]
            self._forget()
            self.start = self._state(list(first))
        firsts, known, moves, accepts, found = self.firsts, self.known, self.moves, self.accepts, []
        for i in [k for k, w in enumerate(words) if w in firsts]:
            state, longest = self.start, {}
            for j in range(i, len(words)):
                w = words[j]
                if w not in known:
                    w = None
                to = moves[state].get(w)
                state = self._move(state, w) if to is None else to
                if state < 0:
                    break
                for t in accepts[state]:
                    longest[t] = j + 1 - i
            found += [(t, i, n) for t, n in longest.items()]
        return found


@lru_cache(maxsize=4)
def _automaton(templates: tuple[str, ...]) -> TemplateAutomaton:
    return TemplateAutomaton(templates)


def scan_licenses(docs: DataFrame, base: Sequence[tuple[str, str]] = BASE, templates: Sequence[tuple[str, float, str]] = TEMPLATES) -> DataFrame:
    """The license wording in every whole text of ``doc_id, text``.

    ``base`` are phrases and labels (templates without regions), ``templates`` further labels, strengths and markup. Returns
    ``doc_id, n_words`` and ``places``: label, base or not, strength (0 to 1), first word (from 0) and number of words of each
    match, by first word; a template matches at most once from one word, at its longest. Null and empty texts have no words and no
    places. Repeated rows are rows of their own; other columns are not read; an empty table gives no rows.
    """
    texts = tuple([t for t, _ in base] + [t for _, _, t in templates])
    labels = pa.array([x for _, x in base] + [x for x, _, _ in templates], pa.string())
    strengths = np.array([MENTION] * len(base) + [s for _, s, _ in templates])
    n_base = len(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(texts)
        for f in batches:
            counts, offsets, places = [], [0], []
            for t in f.column("text").cast(pa.large_string()).cast(pa.large_binary()):
                words = words_of(t.as_py() or b"")
                counts.append(len(words))
                places += automaton.match(words)
                offsets.append(len(places))
            at = np.array(places, np.int64).reshape(-1, 3)
            structs = pa.StructArray.from_arrays(
                [labels.take(pa.array(at[:, 0])), pa.array(at[:, 0] < n_base), pa.array(strengths[at[:, 0]]), pa.array(at[:, 1]), pa.array(at[:, 2])],
                names=["label", "base", "strength", "first_word", "n_words"],
            )
            yield pa.record_batch([f.column("doc_id"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)], names=["doc_id", "n_words", "places"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _KINDS)


def license_labels(docs: DataFrame) -> DataFrame:
    """One row a document of :func:`scan_licenses`: how many base places it has, its first and last, its labels, and as score its strongest wording (0: none)."""
    base = F.filter("places", lambda p: p.base)
    first = F.transform(base, lambda p: p.first_word)

    def joined(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p.label))), ",")

    return scan_licenses(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p.strength)), F.lit(0.0)).alias("score"),
    )
