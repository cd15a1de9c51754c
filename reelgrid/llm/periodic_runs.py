"""Periodic runs of words: stretches that repeat themselves at a short distance.

A suffix automaton takes the words one by one. A link-cut tree over its suffix links keeps, for every state, where its strings ended
last: the path from the newest prefix to the root falls into segments of one colour (last end), and appending word i recolours the path.
A segment of colour e holds the suffixes whose last occurrence ended at e. Where the distance i - e lies within the segment's lengths,
the suffix of that length stands directly before itself: a square with smallest period i - e. The first square of a
run is extended to the run. Each appended word changes O(log n) segments (amortised), so a text takes O(n log n).

Only stretches whose word triples are frequent enough to lie in a run are given to the automaton; a run cannot leave such a stretch, so
nothing is lost. Each text is one row of one task; texts do not depend on each other, and nothing is shuffled.

Nulls: a null or empty text has no words and no runs; a null id is passed through. Repeated rows give equal results each.
Ties of the strongest run: smallest start, then smallest period. Long texts are taken whole; memory is in proportion to the longest
stretch. An empty table gives no rows. Other columns are not read, so their names do not matter.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reelgrid.llm.texts import columns


class Run(NamedTuple):
    start: int
    length: int
    period: int


class _Ends:
    """Last end of every state, as the colour of its path in a link-cut tree over the suffix links.

    A path is one splay tree ordered by depth; its colour is kept at the root of that tree.
    """

    def __init__(self) -> None:
        self.left, self.right, self.up, self.colour = [-1], [-1], [-1], [-1]

    def add(self, parent: int) -> None:
        """The next state, alone on its path below `parent`."""
        self.left.append(-1)
        self.right.append(-1)
        self.up.append(parent)
        self.colour.append(-1)

    def add_above(self, state: int) -> None:
        """The next state, put between `state` and its parent; it ended last where `state` did."""
        self._splay(state)
        new, above = len(self.left), self.left[state]
        self.left.append(above)
        self.right.append(-1)
        self.up.append(state)
        self.colour.append(-1)
        self.left[state] = new
        if above >= 0:
            self.up[above] = new

    def _splay(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        top = x
        while (p := up[top]) >= 0 and (left[p] == top or right[p] == top):
            top = p
        if top == x:
            return
        outside, colour = up[top], self.colour[top]
        while (p := up[x]) != outside:
            g = up[p]
            if g != outside:                                   # the parent first where the three are in line, else x twice
                turns = (p, x) if (left[p] == x) == (left[g] == p) else (x, x)
            else:
                turns = (x,)
            for y in turns:
                p = up[y]
                g = up[p]
                if left[p] == y:
                    b = left[p] = right[y]
                    right[y] = p
                else:
                    b = right[p] = left[y]
                    left[y] = p
                if b >= 0:
                    up[b] = p
                up[p], up[y] = y, g
                if g >= 0:
                    if left[g] == p:
                        left[g] = y
                    elif right[g] == p:
                        right[g] = y
        self.colour[x] = colour

    def recolour(self, state: int, end: int) -> list[tuple[int, int]]:
        """Makes `end` the last end on the path from `state` to the root; gives the old segments as (lowest state, last end)."""
        left, right, up, colour = self.left, self.right, self.up, self.colour
        segments, below, x = [], -1, state
        while x >= 0:
            self._splay(x)
            segments.append((x, colour[x]))
            if right[x] >= 0:                                  # what lies deeper keeps its colour, as a path of its own
                colour[right[x]] = colour[x]
            right[x] = below
            below, x = x, up[x]
        colour[below] = end
        return segments


def _runs(ids: Sequence, min_length: int, min_exponent: int) -> list[Run]:
    """Runs of one stretch, through the automaton."""
    follow: list[dict] = [{}]
    link, size, ends = [-1], [0], _Ends()
    found: list[Run] = []
    run_end: dict[int, int] = {}                               # period: end of its last run
    last, n = 0, len(ids)
    for i, word in enumerate(ids):
        new = len(size)
        follow.append({})
        size.append(i + 1)
        link.append(0)
        p, last = last, new
        while p >= 0 and word not in follow[p]:
            follow[p][word] = new
            p = link[p]
        clone = -1
        if p >= 0:
            q = follow[p][word]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                clone = new + 1
                follow.append(follow[q].copy())
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(word) == q:
                    follow[p][word] = clone
                    p = link[p]
                link[q] = link[new] = clone
        ends.add(link[new])
        if clone >= 0:
            ends.add_above(q)
        segments = ends.recolour(new, i)
        for k, (state, end) in enumerate(segments):
            period = i - end
            shortest = size[segments[k + 1][0]] if k + 1 < len(segments) else 0
            if end >= 0 and shortest < period <= size[state] and run_end.get(period, -1) < i:
                start, stop = i - 2 * period + 1, i + 1
                while start and ids[start - 1] == ids[start - 1 + period]:
                    start -= 1
                while stop < n and ids[stop] == ids[stop - period]:
                    stop += 1
                run_end[period] = stop - 1
                if stop - start >= max(min_length, min_exponent * period):
                    found.append(Run(start, stop - start, period))
    return found


def _stretches(words: list, min_length: int, min_exponent: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the longest stretches all of whose word triples are found often enough for a run.

    A run of period q and length L >= max(min_length, min_exponent * q) holds each of its triples floor((L - 2) / q) times or more.
    """
    need = min(min_length - 2, min_exponent - 1)
    if len(words) < min_length:
        return
    triples = list(zip(words, words[1:], words[2:]))
    counts = Counter(triples)
    if max(counts.values()) < need:
        return
    start = None
    for i, triple in enumerate(triples):
        if counts[triple] >= need:
            if start is None:
                start = i
        elif start is not None:
            if i + 2 - start >= min_length:
                yield start, i + 2
            start = None
    if start is not None and len(words) - start >= min_length:
        yield start, len(words)


def runs_of(words: list, min_length: int = 6, min_exponent: int = 4) -> list[Run]:
    """All runs by start, then period: stretches with smallest period q and length >= max(min_length, min_exponent * q) that no
    neighbouring word extends."""
    if min_length < 3 or min_exponent < 2:
        raise ValueError("runs have three words and two periods at least")
    found = []
    for start, end in _stretches(words, min_length, min_exponent):
        found += [Run(start + r.start, r.length, r.period) for r in _runs(words[start:end], min_length, min_exponent)]
    return sorted(found, key=lambda r: (r.start, r.period))


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest length / period; ties: smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r.length, r.period), r.start, r.period), default=None)


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    drop = bytearray(len(words))
    for r in runs:
        drop[r.start + r.period:r.start + r.length] = b"\1" * (r.length - r.period)
    return [w for w, gone in zip(words, drop) if not gone]


def looped(words: list, h: int | None) -> list:
    """A tenth of the texts made periodic: words from a on become the p words at a again and again. Null h: unchanged."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 6, min_exponent: int = 4,
              prepare: Callable[[list, int | None], list] | None = None, seed: Column | None = None, with_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_words, n_runs, the strongest run (start, length, period, exponent_milli; nulls without one),
    runs_sha256 (`start,length,period` lines), collapsed_sha256, and on demand the collapsed text.

    `prepare` changes the words of a text before the search, from the words and the document's value of `seed`."""
    key = docs.select(F.col(f"`{doc_id}`")).schema[0].dataType.simpleString()
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"),
                      (F.lit(None) if seed is None else seed).cast("long").alias("seed"))
    longs = ["n_words", "n_runs", "start", "length", "period", "exponent_milli"]
    texts = ["runs_sha256", "collapsed_sha256"] + ["collapsed_text"] * with_text

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, list] = {k: [] for k in longs + texts}
            for body, value in zip(*columns(batch, "text", "seed")):
                words = (body or b"").split()
                if prepare:
                    words = prepare(words, value)
                runs = runs_of(words, min_length, min_exponent)
                top = strongest(runs)
                kept = b" ".join(collapsed(words, runs))
                row = [len(words), len(runs), *(top or (None,) * 3), top and 1000 * top.length // top.period,
                       hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
                       hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None]
                for k, v in zip(longs + texts, row):
                    made[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(made[k], pa.int64() if k in longs else pa.string()) for k in made],
                                             names=["doc_id", *made])

    return src.mapInArrow(go, ", ".join([f"doc_id {key}"] + [f"{k} long" for k in longs] + [f"{k} string" for k in texts]))


def seeds(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary"))
