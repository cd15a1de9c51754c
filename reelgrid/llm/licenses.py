"""License scans: templates with optional and replaceable regions, compiled into token automata.

A template is written in words; `[ ... ]` is an optional region, `{name:k}` a replaceable one of 0 to k
words. A template compiles into states, one before each mandatory word; the moves that skip
optional regions and the counted free words are worked out once. A text is accepted where the
mandatory words stand exactly, and only the regions differ.

A null text is empty; ids, ties and repeated rows need no care, since rows are scanned one by one.
Long texts are taken whole. An empty table gives no rows. Other columns are not read, so their names do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reelgrid.llm.texts import WORD_BYTES, columns

#: The phrases of the base labels.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Mandatory wording of public license notices, with their optional and replaceable regions.
TEMPLATES = {
    "mit-notice": "[this software is] [released] [licensed] [distributed] under the [terms of the] [expat] mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                "documentation files the software to deal in the software without restriction including without limitation the "
                "rights to use copy modify merge publish distribute sublicense and or sell copies of the software [and to permit "
                "persons to whom the software is furnished to do so] [subject to the following conditions]",
    "apache-2.0": "licensed under the apache license [version] 2 0 [the license] [you may not use this file except in compliance "
                  "with the license]",
    "gpl-notice": "under the terms of the gnu [lesser] [library] [affero] general public license [as published by {publisher:6} "
                  "foundation]",
    "gpl-version": "gnu [lesser] [affero] general public license [v] [version] {number:1} [or [at your option] any later version]",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
                "following conditions are met",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
                "provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by": "[licensed under {a:2}] creative commons attribution {kind:4} license",
    "copyright-reserved": "copyright [c] {year:2} {holder:8} all rights reserved",
}


@dataclass(frozen=True)
class Automaton:
    """Moves of one template: `steps[state]` = {word: next state}; `free[state]` = next state on any word."""

    label: str
    steps: tuple[dict[bytes, tuple[int, ...]], ...]
    free: tuple[tuple[int, ...], ...]
    accepting: frozenset[int]
    base: bool


def _parse(tokens: list[str], at: int, closing: bool) -> tuple[list, int]:
    items: list = []
    while at < len(tokens):
        tok = tokens[at]
        if tok == "]":
            if not closing:
                raise ValueError("a region is closed that was never opened")
            return items, at + 1
        if tok == "[":
            inner, at = _parse(tokens, at + 1, True)
            items.append(("optional", inner))
            continue
        free = re.fullmatch(r"\{\w+:(\d+)\}", tok)
        items.append(("free", int(free[1])) if free else ("word", tok.encode()))
        at += 1
    if closing:
        raise ValueError("a region is never closed")
    return items, at


def compile_template(label: str, template: str, base: bool = False) -> Automaton:
    """Thompson construction with the empty moves closed afterwards, so that a scan needs none."""
    words: list[tuple[int, bytes | None, int]] = []
    empty: dict[int, set[int]] = {}
    count = 1

    def build(items: list, start: int) -> int:
        nonlocal count
        here = start
        for kind, what in items:
            if kind == "optional":
                end = build(what, here)
                empty.setdefault(here, set()).add(end)
                here = end
                continue
            first, reach = here, []
            for _ in range(1 if kind == "word" else what):
                words.append((here, what if kind == "word" else None, count))
                here, count = count, count + 1
                reach.append(here)
            if kind == "free":
                for s in [first, *reach[:-1]]:
                    if s != here:
                        empty.setdefault(s, set()).add(here)
        return here

    parsed, _ = _parse(re.findall(r"\[|\]|\{\w+:\d+\}|[^\s\[\]]+", template), 0, False)
    last = build(parsed, 0)

    def closed(s: int) -> set[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in empty.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    reach = [closed(s) for s in range(count)]
    steps: list[dict[bytes, set[int]]] = [{} for _ in range(count)]
    free: list[set[int]] = [set() for _ in range(count)]
    for s in range(count):
        for a, word, b in words:
            if a in reach[s]:
                (free[s] if word is None else steps[s].setdefault(word, set())).add(b)
    ends = frozenset(s for s in range(count) if last in reach[s])
    if 0 in ends:
        raise ValueError("a template needs a mandatory word")
    return Automaton(label, tuple({w: tuple(sorted(t)) for w, t in m.items()} for m in steps),
                     tuple(tuple(sorted(f)) for f in free), ends, base)


def compile_all() -> list[Automaton]:
    return ([compile_template(k, v, True) for k, v in BASE.items()]
            + [compile_template(k, v) for k, v in TEMPLATES.items()])


def longest_match(words: list[bytes], start: int, a: Automaton) -> int:
    """End of the longest accepted run from `start`; -1 if none."""
    states, end, at = {0}, -1, start
    while states and at < len(words):
        word, after = words[at], set()
        for s in states:
            after.update(a.steps[s].get(word, ()))
            after.update(a.free[s])
        at += 1
        states = after
        if states & a.accepting:
            end = at
    return end


def scan_words(words: list[bytes], entry: dict[bytes, list[Automaton]]) -> tuple[list[int], set[str], set[str], int]:
    """(starts of base places, base labels, all labels, words inside any accepted run)."""
    places: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    covered: set[int] = set()
    for i in [i for i, w in enumerate(words) if w in entry]:
        for a in entry[words[i]]:
            end = longest_match(words, i, a)
            if end > 0:
                labels.add(a.label)
                covered.update(range(i, end))
                if a.base:
                    base.add(a.label)
                    places.append(i)
    return places, base, labels, len(covered)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (share of words in accepted runs)."""
    automata = compile_all()
    entry: dict[bytes, list[Automaton]] = {}
    for a in automata:
        if a.free[0]:
            raise ValueError(f"{a.label}: a template begins with a word")
        for word in a.steps[0]:
            entry.setdefault(word, []).append(a)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("__text"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in next(columns(batch, "__text")):
                words = (body or b"").translate(WORD_BYTES).split()
                places, base, labels, covered = scan_words(words, entry)
                rows.append((len(words), len(places), min(places, default=None), max(places, default=None),
                             ",".join(sorted(base)), ",".join(sorted(labels)), covered / len(words) if words else 0.0))
            made = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(v, t) for v, t in zip(made, kinds)],
                                             names=["doc_id", *names])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(go, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, "
                              "base_labels string, labels string, score double")
