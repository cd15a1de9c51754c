"""Rewriting narration scripts: fewer changes of voice, no scraps, a narrated share near its target.

A script row is clip, start_ms, end_ms, mode (narrate / orig); the parts of a clip do not meet. The rules look at a whole script (which
pair is the shortest, which part brings the share nearest), so a clip's parts, times and modes without texts, are the state
of one run. Neighbours are a linked list and choices come from a heap or a sorted list, so n parts take n log n.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, functions as F

from reelgrid.operators.folds import unfold_runs

NARRATE, ORIG = "narrate", "orig"


@dataclass
class Part:
    start: int
    end: int
    mode: str
    #: a barrier lies at the end, or the part has words of its own to be told
    mark: bool = False

    @property
    def size(self) -> int:
        return self.end - self.start


class _Chain:
    """Parts in order, with removal and both neighbours in constant time."""

    def __init__(self, parts: list[Part]) -> None:
        self.parts: list[Part | None] = list(parts)
        self.after = [*range(1, len(parts)), -1] if parts else []
        self.before = list(range(-1, len(parts) - 1))

    def remove(self, i: int) -> None:
        a, b = self.before[i], self.after[i]
        if a >= 0:
            self.after[a] = b
        if b >= 0:
            self.before[b] = a
        self.parts[i] = None

    def left(self) -> list[Part]:
        return [p for p in self.parts if p is not None]


def joined_orig(parts: list[Part], gap: int = 300) -> list[Part]:
    """Neighbouring original parts less than `gap` apart become one."""
    out: list[Part] = []
    for p in parts:
        if out and p.mode == out[-1].mode == ORIG and abs(p.start - out[-1].end) < gap:
            out[-1].end = p.end
        else:
            out.append(p)
    return out


def limited_changes(parts: list[Part], most: int) -> list[Part]:
    """The shorter part of the pair with the shortest one is swallowed by the other, until the voice changes at most `most` times.

    Never across a barrier (`mark` of the earlier part), never the first part, never the last original one."""
    chain, n = _Chain(parts), len(parts)
    origs = sum(p.mode == ORIG for p in parts)
    changes = sum(a.mode != b.mode for a, b in zip(parts, parts[1:]))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        """The pair of part i and the next one, with the sizes it is judged by."""
        j = chain.after[i] if i >= 0 else -1
        if j < 0:
            return
        a, b = chain.parts[i], chain.parts[j]
        if a.mode != b.mode and not a.mark and not (i == 0 and a.size <= b.size):
            heappush(heap, (min(a.size, b.size), a.start, i, a.size, b.size))

    for i in range(n - 1):
        offer(i)
    while changes > most and heap:
        _, _, i, size_a, size_b = heappop(heap)
        a = chain.parts[i]
        j = chain.after[i]
        if a is None or j < 0 or (a.size, chain.parts[j].size) != (size_a, size_b):
            continue                                   # the pair has changed since; it was offered anew then
        b = chain.parts[j]
        victim, host = (i, j) if a.size <= b.size else (j, i)
        if chain.parts[victim].mode == ORIG and origs <= 1:
            continue
        origs -= chain.parts[victim].mode == ORIG
        if victim == i:
            b.start = a.start
        else:
            a.end, a.mark = b.end, b.mark
        around = [k for k in (chain.before[i], i, j, chain.after[j]) if k >= 0]
        changes -= sum(chain.parts[x].mode != chain.parts[y].mode for x, y in zip(around, around[1:]))
        chain.remove(victim)
        around.remove(victim)
        changes += sum(chain.parts[x].mode != chain.parts[y].mode for x, y in zip(around, around[1:]))
        offer(chain.before[host])
        offer(host)
    return chain.left()


def mended(parts: list[Part], shortest_orig: int, shortest_narrate: int, most_orig: int) -> list[Part]:
    """Three rules in turn: short original parts go to the longer narrated neighbour (one original part stays); short narration between two
    original parts joins both; of more than `most_orig` original parts the longest stay, others are told (`mark`) or go to a neighbour.

    Each step removes a part or turns one into narration, so the rules come to an end; a second pass changes nothing of the first two kinds.
    """
    chain = _Chain(parts)

    def host(i: int) -> tuple[Part | None, bool]:
        """(the longer narrated neighbour, whether it comes before)."""
        p, q = (chain.parts[k] if k >= 0 and chain.parts[k].mode == NARRATE else None for k in (chain.before[i], chain.after[i]))
        return (p, True) if p and (not q or p.size >= q.size) else (q, False)

    def give(i: int) -> bool:
        to, earlier = host(i)
        if to is None:
            return False
        if earlier:
            to.end = chain.parts[i].end
        else:
            to.start = chain.parts[i].start
        return True

    origs = sum(p.mode == ORIG for p in parts)
    short = [(p.size, i) for i, p in enumerate(parts) if p.mode == ORIG and p.size < shortest_orig]
    heapify(short)
    while short and origs > 1:
        _, i = heappop(short)
        if chain.parts[i] is None or not give(i):
            continue                                   # nobody to take it; asked again when a neighbour goes
        beside = [k for k in (chain.before[i], chain.after[i]) if k >= 0]
        chain.remove(i)
        origs -= 1
        for k in beside:
            if chain.parts[k].mode == ORIG and chain.parts[k].size < shortest_orig:
                heappush(short, (chain.parts[k].size, k))

    out: list[Part] = []
    rest = chain.left()
    i = 0
    while i < len(rest):
        p = rest[i]
        if (out and p.mode == NARRATE and p.size < shortest_narrate and out[-1].mode == ORIG and i + 1 < len(rest) and rest[i + 1].mode == ORIG):
            out[-1].end = rest[i + 1].end
            i += 2
        else:
            out.append(p)
            i += 1

    chain = _Chain(out)
    ranked = sorted((i for i, p in enumerate(out) if p.mode == ORIG), key=lambda i: -out[i].size)
    for i in sorted(ranked[most_orig:], reverse=True):
        if out[i].mark:
            out[i].mode = NARRATE
        elif give(i):
            chain.remove(i)
    return joined_orig(chain.left())


def near_ratio(parts: list[Part], percent: int, slack: int, keep: int) -> list[Part]:
    """Middle narration is given back to the original sound while the narrated share is over `percent` + `slack` and more than `keep`
    parts narrate: each time the part that brings the share nearest to `percent`, the first one on ties, and none that does not help."""
    told = [i for i, p in enumerate(parts) if p.mode == NARRATE]
    total = sum(p.size for p in parts)
    now = sum(parts[i].size for i in told)
    left = len(told)
    middle = sorted((parts[i].size, i) for i in told[1:-1])          # sizes, each with the first place first
    goal = percent * total                                           # shares are compared as hundredths of the total
    while middle and left > max(1, keep) and 100 * now > (percent + slack) * total:
        want = now * 100 - goal                                      # taking away this much (x 100) meets the goal
        at = bisect_left(middle, (-(-want // 100), -1))
        below = bisect_left(middle, (middle[at - 1][0], -1)) if at else -1
        options = [k for k in (below, at) if 0 <= k < len(middle)]
        best = min(options, key=lambda k: (abs(want - 100 * middle[k][0]), middle[k][1]))
        if abs(want - 100 * middle[best][0]) >= abs(want):
            break
        size, i = middle.pop(best)
        parts[i].mode = ORIG
        now -= size
        left -= 1
    return joined_orig(parts)


def rewrite(parts: DataFrame, clip: list[str], rule: Callable[[list[Part]], list[Part]], mark: str | None = None) -> DataFrame:
    """Each clip's parts through a rule: clip, start_ms, end_ms, mode. `mark` names a boolean column for the rule."""
    rows = parts.select(*clip, "start_ms", "end_ms", "mode", (F.col(mark) if mark else F.lit(False)).alias("mark"))

    def step(held: list[Part], *row) -> list:
        held.append(Part(*row))
        return []

    def finish(held: list[Part]) -> list:
        return [(p.start, p.end, p.mode) for p in rule(held)]

    return unfold_runs(rows, clip, ["start_ms"], ["start_ms", "end_ms", "mode", "mark"], "start_ms long, end_ms long, mode string", list, step, finish)


def limit_role_changes(parts: DataFrame, clip: list[str], most: int = 8, barrier: str | None = None) -> DataFrame:
    return rewrite(parts, clip, lambda x: limited_changes(x, most), barrier)


def fix_structure(parts: DataFrame, clip: list[str], shortest_orig: int = 3000, shortest_narrate: int = 6000, most_orig: int = 2,
                  told: str | None = None) -> DataFrame:
    return rewrite(parts, clip, lambda x: mended(x, shortest_orig, shortest_narrate, most_orig), told)


def enforce_ratio(parts: DataFrame, clip: list[str], percent: int = 45, slack: int = 12, keep: int = 2) -> DataFrame:
    return rewrite(parts, clip, lambda x: near_ratio(x, percent, slack, keep))
