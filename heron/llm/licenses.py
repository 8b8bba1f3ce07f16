"""Licence scans: exact phrases, and fuzzy search for short notices.

A text is lower-cased (A-Z) and its words, runs of digits, ASCII letters and everything beyond ASCII, are joined by single
spaces. Base labels come from phrases whose words stand consecutively there. For the fuzzy search a notice of n characters may
differ by up to k = max(1, n // SHARE) edits (characters put in, left out or replaced). It is split into k + 1 seeds: by the
pigeonhole principle one of them is unchanged in any such occurrence. One automaton finds all seeds of all notices, which gives
the windows that may hold an occurrence. As an edit spoils at most GRAM of a notice's GRAM-character parts, a window with too
few of them has none; the others are searched by the regex library for the notice with at most k errors, which verifies it and
counts the edits. Windows of a notice that overlap are searched as one up to a bounded length. So no place is lost where a
notice stands, whatever is around it. Where occurrences of several notices overlap, those with the least share of edits count.

The score is 1 where a base phrase stands, or else the best 1 - edits / n of a notice found, or 0.

Cases: a null or empty text has no words, labels '' and score 0; a text of any length is taken whole; equal ids and repeated
rows are rows of their own, as are rows with a null id; equal matches are told from the leftmost on; an empty table gives an
empty result; other columns are never read. A notice or phrase without words is refused.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, utf8

#: Characters of a notice for each edit that is allowed; characters of the parts that are counted in a window.
SHARE, GRAM = 16, 4
#: Characters of windows that are searched as one.
JOINED = 4096
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: The beginnings of widely used notices, by the label that they stand for.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("made available under the terms of the eclipse public license", "epl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under a creative commons attribution", "cc-by"),
)

_WORDS = bytes.maketrans(bytes(range(0x80)), bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(0x80)))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
SPANS = "doc_id long, label string, notice string, first_word long, last_word long, edits int, found string"


@dataclass(frozen=True)
class Span:
    """Characters [start, end) of the normal form that are a notice but for `edits`."""

    notice: int
    start: int
    end: int
    edits: int


def normal_form(text: bytes) -> str:
    return b" ".join(text.translate(_WORDS).split()).decode()


def places(words: str, phrase: str) -> list[int]:
    """The characters where the phrase's words stand consecutively in a normal form."""
    padded, sought = f" {words} ", f" {phrase} "
    out, at = [], padded.find(sought)
    while at >= 0:
        out.append(at)
        at = padded.find(sought, at + 1)
    return out


class Scanner:
    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES, phrases: tuple[tuple[str, str], ...] = PHRASES, share: int = SHARE):
        import ahocorasick
        import regex

        self.phrases = [(normal_form(p.encode()), label) for p, label in phrases]
        self.notices = [(normal_form(n.encode()), label) for n, label in notices]
        if not all(x for x, _ in self.phrases + self.notices):
            raise ValueError("a phrase or notice has no words")
        self.edits = [max(1, len(n) // share) for n, _ in self.notices]
        self.patterns = [regex.compile(f"(?e)(?:{regex.escape(n)}){{e<={k}}}") for (n, _), k in zip(self.notices, self.edits, strict=True)]
        self.grams = [[n[i : i + GRAM] for i in range(len(n) - GRAM + 1)] for n, _ in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for j, ((n, _), k) in enumerate(zip(self.notices, self.edits, strict=True)):
            cuts = [len(n) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(n[a:b], []).append((j, a))
        self.seeds = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.seeds.add_word(seed, (len(seed), uses))
        self.seeds.make_automaton()

    def windows(self, words: str) -> dict[int, list[tuple[int, int]]]:
        """By notice, the stretches that hold every occurrence of it: a seed at p that begins a characters into the notice
        leaves room for k edits on both sides."""
        out: dict[int, list[tuple[int, int]]] = {}
        for end, (size, uses) in self.seeds.iter(words):
            at = end + 1 - size
            for j, a in uses:
                k, n = self.edits[j], len(self.notices[j][0])
                lo, hi = max(0, at - a - k), min(len(words), at - a + n + k)
                mine = out.setdefault(j, [])
                if mine and lo <= mine[-1][1] and hi - mine[-1][0] <= JOINED:
                    mine[-1] = (min(lo, mine[-1][0]), max(hi, mine[-1][1]))
                else:
                    mine.append((lo, hi))
        return out

    def likely(self, notice: int, window: str) -> bool:
        grams = self.grams[notice]
        return sum(g in window for g in grams) >= len(grams) - GRAM * self.edits[notice]

    def spans(self, words: str) -> list[Span]:
        """Occurrences of notices by place, those of one notice without overlap."""
        found = []
        for j, stretches in self.windows(words).items():
            done = 0  # what lies before it belongs to an occurrence
            for lo, hi in stretches:
                if not self.likely(j, words[lo:hi]):
                    continue
                for m in self.patterns[j].finditer(words, max(lo, done), hi):
                    if m.end() > m.start():
                        gap = len(m[0]) - len(m[0].lstrip())
                        found.append(Span(j, m.start() + gap, m.end(), sum(m.fuzzy_counts)))
                        done = m.end()
        return sorted(found, key=lambda s: (s.start, s.end, s.notice))

    def distance(self, span: Span) -> float:
        return span.edits / len(self.notices[span.notice][0])

    def best(self, spans: list[Span]) -> list[Span]:
        """Spans in order of their starts, without those that a closer one of another label overlaps. Those of one notice
        don't overlap, so only the neighbours within the longest span are looked at."""
        longest = max((s.end - s.start for s in spans), default=0)
        out = []
        for i, s in enumerate(spans):
            lo, hi = i, i + 1
            while lo and spans[lo - 1].start > s.start - longest:
                lo -= 1
            while hi < len(spans) and spans[hi].start < s.end:
                hi += 1
            label, d = self.notices[s.notice][1], self.distance(s)
            if not any(t.end > s.start and self.distance(t) < d and self.notices[t.notice][1] != label for t in spans[lo:hi]):
                out.append(s)
        return out

    def scan(self, words: str) -> tuple[int, int, int | None, int | None, str, str, float]:
        """Words, base places, the first and last of these in words, base labels, all labels, score."""
        base, at = set(), []
        for phrase, label in self.phrases:
            if got := places(words, phrase):
                base.add(label)
                at += got
        spans = self.best(self.spans(words))
        labels = base | {self.notices[s.notice][1] for s in spans}
        near = max((1 - self.distance(s) for s in spans), default=0.0)
        word = lambda place: words.count(" ", 0, place)
        n = words.count(" ") + 1 if words else 0
        first, last = (word(min(at)), word(max(at))) if at else (None, None)
        return n, len(at), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else near


@lru_cache(maxsize=4)
def scanner(notices: tuple, phrases: tuple, share: int) -> Scanner:
    return Scanner(notices, phrases, share)


def _scan(batches: Iterable[pa.RecordBatch], notices: tuple, phrases: tuple, share: int) -> Iterator[pa.RecordBatch]:
    s = scanner(notices, phrases, share)
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for b in steps(batches):
        got = [s.scan(normal_form(x)) for x in utf8(b.column("text"))]
        yield pa.record_batch([b.column("doc_id"), *[pa.array([r[k] for r in got], kind) for k, kind in enumerate(kinds)]], names=names)


def _spans(batches: Iterable[pa.RecordBatch], notices: tuple, share: int) -> Iterator[pa.RecordBatch]:
    s = scanner(notices, (), share)
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    names = [x.split()[0] for x in SPANS.split(", ")]
    for b in steps(batches):
        rows = []
        for doc_id, x in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), strict=True):
            words = normal_form(x)
            at = before = 0
            for p in s.best(s.spans(words)):
                notice, label = s.notices[p.notice]
                before, at = before + words.count(" ", at, p.start), p.start
                rows.append((doc_id, label, notice, before, before + words.count(" ", p.start, p.end), p.edits, words[p.start : p.end]))
        yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text")


def scan_licenses(docs: DataFrame, notices: tuple = NOTICES, phrases: tuple = PHRASES, share: int = SHARE) -> DataFrame:
    """A row for each document: its words, the places of base phrases, the labels of these and of the notices found, score."""
    return _rows(docs).mapInArrow(partial(_scan, notices=notices, phrases=phrases, share=share), SCHEMA)


def notice_spans(docs: DataFrame, notices: tuple = NOTICES, share: int = SHARE) -> DataFrame:
    """A row for each occurrence of a notice: its first and last word, edits and the words found."""
    return _rows(docs).mapInArrow(partial(_spans, notices=notices, share=share), SPANS)
