"""License scans: texts that match license templates with optional and replaceable regions.

A template is a text with marks in the manner of license-list templates:
``<<optional>>`` to ``<</optional>>`` may be absent, ``<<any:N>>`` stands for up to N words of any kind.
All other wording is mandatory. Templates become automata over word hashes whose
states are sets of places; a template is accepted where a run of words leads from
its start to its end. A text is looked at only from the places where a
template's first mandatory words stand, so scans are linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import LETTERS_DIGITS, Block, blocks

#: Fixed values of the base scan: phrase, label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Templates, label first. Wording that a license or its customary notice must have.
TEMPLATES = (
    ("mit-notice", "<<optional>>this <<any:3>> is<</optional>> released under the<<optional>> terms of the<</optional>> mit license"),
    (
        "apache-2.0-notice",
        "licensed under the apache license version 2 0<<optional>> the license you may not use "
        "this file except in compliance with the license<</optional>>",
    ),
    (
        "gpl-3.0-notice",
        "<<optional>>this <<any:4>> is<</optional>><<optional>> licensed<</optional>> under the<<optional>> terms of the<</optional>>"
        "<<optional>> gnu<</optional>> general public license<<optional>> as published by the free software foundation<</optional>>"
        "<<optional>> either<</optional>> version 3",
    ),
    ("cc-by-nc-4.0-notice", "licensed under<<optional>> the<</optional>> cc by nc 4 0"),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of <<any:10>> to deal in <<any:3>> without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software",
    ),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met<<optional>> 1<</optional>> redistributions of source code must retain the above copyright notice",
    ),
)

_MARK = re.compile(r"<<(optional|/optional|any:\d+)>>")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Automaton(NamedTuple):
    """Steps by state: (word or None for any word, next state). ``skips``: steps that take no word."""

    label: str
    steps: list[list[tuple[str | None, int]]]
    skips: list[list[int]]
    end: int
    starts: list[str]  # the words a match may begin with
    needed: list[str]  # the longest mandatory run, by which a text is found worth a look
    mandatory: int

    def closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def reach(self, words: list[str], at: int) -> int | None:
        """Where the longest match from ``at`` ends, if there is one."""
        states, best = self.closed({0}), None
        while states:
            if self.end in states:
                best = at
            if at == len(words):
                break
            states = self.closed({to for s in states for word, to in self.steps[s] if word is None or word == words[at]})
            at += 1
        return best


def compiled(label: str, template: str) -> Automaton:
    """The automaton of a template; regions do not nest but ``any`` may stand in ``optional``."""
    steps: list[list] = [[]]
    skips: list[list] = [[]]
    opened: list[int] = []
    runs: list[list[str]] = [[]]
    mandatory = 0

    def grow() -> int:
        steps.append([])
        skips.append([])
        return len(steps) - 1

    at = 0
    for part in _MARK.split(template):
        if part == "optional":
            opened.append(at)
            runs.append([])
        elif part == "/optional":
            to = grow()
            skips[at].append(to)
            skips[opened.pop()].append(to)
            at = to
        elif part.startswith("any:"):
            to = grow()
            skips[at].append(to)
            for _ in range(int(part[4:])):
                new = grow()
                steps[at].append((None, new))
                skips[new].append(to)
                at = new
            at = to
            runs.append([])
        else:
            for word in _WORD.findall(part.lower()):
                new = grow()
                steps[at].append((word, new))
                at = new
                if not opened:
                    runs[-1].append(word)
                    mandatory += 1
    out = Automaton(label, steps, skips, at, [], max(runs, key=len), mandatory)
    out.starts.extend(sorted({w for s in out.closed({0}) for w, _ in out.steps[s] if w is not None}))
    return out


def _hash_of(words: list[str]) -> np.ndarray:
    block = next(blocks(pa.array([" ".join(words)]), LETTERS_DIGITS))
    return block.hashes()


def _places(hashes: np.ndarray, doc: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Words where the phrase begins, within one text."""
    n = len(hashes) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    good = doc[:n] == doc[len(phrase) - 1 :][:n]
    for j, h in enumerate(phrase):
        good &= hashes[j : j + n] == h
    return np.flatnonzero(good)


def _words_of(block: Block, lo: int, hi: int) -> list[str]:
    return [bytes(block.bytes[s:e]).decode("utf-8") for s, e in zip(block.start[lo:hi], block.end[lo:hi], strict=True)]


def _matches(block: Block, hashes: np.ndarray, first: np.ndarray, automata: list) -> list[tuple[int, str, int, int]]:
    """(text, label, first word, end) of the accepted runs, none overlapping another of its label."""
    out = []
    for automaton, needed, starts in automata:
        worth = np.unique(block.doc[_places(hashes, block.doc, needed)])
        for d in worth:
            lo, hi = first[d], first[d + 1]
            here = lo + np.flatnonzero(np.isin(hashes[lo:hi], starts))
            words = _words_of(block, lo, hi)
            done = 0
            for at in here - lo:
                if at >= done and (end := automaton.reach(words, int(at))) is not None and end > at:
                    out.append((int(d), automaton.label, int(at), end))
                    done = end
    return out


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` of every row.

    A-Z are lower-cased; words are runs of letters and digits, and of all that is not
    ASCII. The base are the places of the phrases. ``labels`` adds those of the
    accepted templates; ``spans`` has their (label, first word, words).
    ``score`` is 1 for an accepted template, 0.5 for phrases alone, else 0. Null texts
    are empty: no words, no places, empty labels. Repeated rows and rows
    without an id are scanned like others; other columns are not read.
    """
    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label:string,word:long,words:long>>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = [(label, _hash_of(phrase.split())) for phrase, label in phrases]
        automata = [
            (a, _hash_of(a.needed), _hash_of(a.starts)) for a in (compiled(label, text) for label, text in templates)
        ]
        out_schema = pa.schema(
            [
                *[(n, pa.int64()) for n in ("doc_id", "n_words", "n_base", "first_word", "last_word")],
                ("base_labels", pa.string()),
                ("labels", pa.string()),
                ("score", pa.float64()),
                ("spans", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64())]))),
            ]
        )
        for batch in batches:
            for block in blocks(batch.column(1), LETTERS_DIGITS):
                hashes, count = block.hashes(), block.counts()
                first = np.concatenate([[0], np.cumsum(count)])
                n = block.texts
                total = np.zeros(n, dtype=np.int64)
                low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                base_labels: dict[int, set] = {}
                for label, phrase in base:
                    at = _places(hashes, block.doc, phrase)
                    owner, place = block.doc[at], at - first[block.doc[at]]
                    total += np.bincount(owner, minlength=n)
                    np.minimum.at(low, owner, place)
                    np.maximum.at(high, owner, place)
                    for d in np.unique(owner):
                        base_labels.setdefault(int(d), set()).add(label)
                spans: dict[int, list] = {}
                for d, label, at, end in _matches(block, hashes, first, automata):
                    spans.setdefault(d, []).append({"label": label, "word": at, "words": end - at})
                has = total > 0
                ids = batch.column(0).slice(block.first, n)
                labels = [base_labels.get(d, set()) | {s["label"] for s in spans.get(d, ())} for d in range(n)]
                columns = [
                    ids,
                    pa.array(count),
                    pa.array(total),
                    pa.array(low, mask=~has),
                    pa.array(high, mask=~has),
                    pa.array([",".join(sorted(base_labels.get(d, ()))) for d in range(n)]),
                    pa.array([",".join(sorted(x)) for x in labels]),
                    pa.array([1.0 if d in spans else 0.5 if has[d] else 0.0 for d in range(n)]),
                    pa.array([spans.get(d, []) for d in range(n)], out_schema.field("spans").type),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=out_schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
