"""Conversation structure repair: the cheapest edits that make the roles of a conversation take turns.

A repaired conversation has the role initials `(s?(ua)+)?`. Rows are kept (0), given the role that is due (3) or deleted (4; a must for
blank and repeated rows); an empty row with the role that is due may be inserted anywhere (3); a truncated row that stays costs 3 more.
Rows passed and state of the pattern span a lattice with integer costs. Its shortest paths come from the auction algorithm: every
node has a price, a path grows from the start along arcs that meet the prices (extension), and where none does, the last node's price
rises to the cheapest way on and the path gives that node up (contraction). When the path reaches the goal, the prices are an
optimal dual: every shortest path uses tight arcs alone, and the least audit in ASCII order is traced over the tight arcs that lead to the goal.

Sorted rows are cut into blocks of a few rows, ranges of one conversation in several tasks included. A block is solved for every state
that it may begin and end with; equal blocks of a worker are solved once. Joining the blocks of a conversation takes one small
step a block. The blocks carry no texts; one task reads a conversation's rows only as a stream, to digest the repaired text.
What is held of one conversation there is in proportion to its audit, one letter a row, which is a column of the result anyway.

Nulls: a null role or text is one space, a null conversation id is a conversation, null turns come first. Ties: rows of one turn are ordered
by role, then by the digest of the text; equal rows are repeats. Of empty roles there is no initial, so such a row is never kept as it is.
Long texts stream. An empty table gives no rows; a conversation without rows gives zeros. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

#: States of the pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a. The role that is due in each, where it leads, and what is missing at the end.
DUE = "uuau"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
TAIL = ("", "II", "I", "")
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK_ROWS = 32
#: Beyond every path.
FAR = 1 << 60
_BLANKS = " \t\n\x0b\x0c\r"


class Arc(NamedTuple):
    letters: str
    to: int
    cost: int


def lattice(rows: tuple[tuple[str, str, int], ...]) -> list[list[Arc]]:
    """Arcs of node 4 * rows passed + state, in order of their letters. A row: initial, fault (`-`, `t` truncated, `x` to be deleted), copies.

    Copies beyond the first are deleted at once: an insertion between them could as well follow them, with a smaller audit."""
    arcs: list[list[Arc]] = []
    for i, (initial, fault, copies) in enumerate(rows):
        extra, rest = "D" * (copies - 1), DELETE * (copies - 1)
        for state in range(4):
            due = DUE[state]
            after = STEP[state, due]
            here = [Arc("D" + extra, 4 * i + 4 + state, DELETE + rest), Arc("I", 4 * i + after, INSERT)]
            if fault != "x":
                late = TRUNCATED if fault == "t" else 0
                if (state, initial) in STEP:
                    here.append(Arc("K" + extra, 4 * i + 4 + STEP[state, initial], late + rest))
                if initial != due:
                    here.append(Arc("R" + extra, 4 * i + 4 + after, REROLE + late + rest))
            arcs.append(here)
    return arcs + [[] for _ in range(4)]


def leading(arcs: list[list[Arc]], goal: int) -> list[list[Arc]]:
    """Only the arcs from which the goal can be reached."""
    leads, left = {goal}, [[] for _ in arcs]
    for row in range(goal // 4, -1, -1):
        for _ in range(4):                                     # insertions stay in their row, three of them at most
            leads.update(n for n in range(4 * row, 4 * row + 4) if n not in leads and any(a.to in leads for a in arcs[n]))
    for n in leads:
        left[n] = [a for a in arcs[n] if a.to in leads]
    return left


def auction(arcs: list[list[Arc]], price: list[int], start: int, goal: int) -> None:
    """Raises the prices until a shortest path from start to goal is tight. All arcs must lead to the goal. Prices must not exceed any
    arc's cost plus the price beyond it, as zeros do, and stay so."""
    path = [start]
    while (at := path[-1]) != goal:
        best, to = min((a.cost + price[a.to], a.to) for a in arcs[at])
        if price[at] < best:                                   # contraction
            price[at] = best
            if len(path) > 1:
                path.pop()
        else:                                                  # extension
            path.append(to)


def least_audit(arcs: list[list[Arc]], price: list[int], start: int, goal: int) -> str:
    """The least letters in ASCII order over tight arcs from start to goal, after an auction between them."""
    tight = leading([[a for a in here if price[n] == a.cost + price[a.to]] for n, here in enumerate(arcs)], goal)
    letters, at = [], start
    while at != goal:
        letters.append(tight[at][0].letters)
        at = tight[at][0].to
    return "".join(letters)


@lru_cache(maxsize=1 << 15)
def solve(rows: tuple[tuple[str, str, int], ...], begins: tuple[int, ...]) -> tuple[list[int], list[str]]:
    """(costs, audits) by 4 * first state + last state; cost -1 where there is no way."""
    arcs = lattice(rows)
    costs, audits = [-1] * 16, [""] * 16
    for end in range(4):
        goal = 4 * len(rows) + end
        useful, price = leading(arcs, goal), [0] * len(arcs)
        for begin in reversed(begins):
            if useful[begin] or begin == goal:
                auction(useful, price, begin, goal)
                costs[4 * begin + end] = price[begin] - price[goal]
                audits[4 * begin + end] = least_audit(useful, price, begin, goal)
    return costs, audits


def joined(blocks: list[tuple[list[int], list[str]]]) -> tuple[int, str]:
    """(cost, least audit) over the blocks of a conversation, from state 0."""
    ahead = [len(t) * INSERT for t in TAIL]                    # cheapest way on from each state
    prices = [ahead]
    for costs, _ in reversed(blocks):
        ahead = [min([costs[4 * s + e] + ahead[e] for e in range(4) if costs[4 * s + e] >= 0], default=FAR) for s in range(4)]
        prices.append(ahead)
    prices.reverse()
    state, parts = 0, []
    for k, (costs, audits) in enumerate(blocks):
        # audits to different states differ before either ends: both pass the same rows, and the state follows from the letters
        letters, state = min((audits[4 * state + e], e) for e in range(4)
                             if costs[4 * state + e] >= 0 and costs[4 * state + e] + prices[k + 1][e] == prices[k][state])
        parts.append(letters)
    return prices[0][0], "".join(parts) + TAIL[state]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        names = batch.schema.names
        for values in zip(*[c.to_pylist() for c in batch.columns]):
            yield dict(zip(names, values))


_BLOCK = ("ck string, pid int, seq long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
          "low long, high long, turns long, costs array<int>, audits array<string>")


def _block_of(rows: list[dict], seq: int, opens: bool) -> dict:
    """One block; `opens`: no row of the conversation may come before it, so it begins in state 0."""
    coded, blank, duplicate, truncated, illegal, last = [], 0, 0, 0, 0, None
    turns = sorted({r["turn"] for r in rows if r["turn"] is not None})
    for r in rows:
        more = r["copies"] - 1
        fault = "x" if r["blank"] or r["repeat"] else "t" if r["truncated"] else "-"
        coded.append((r["initial"], fault, r["copies"]))
        if r["blank"]:
            blank += 1 + more
        else:
            duplicate += more + bool(r["repeat"])
            truncated += fault == "t"
        illegal += more + (last is not None and last + r["initial"] not in LEGAL)      # no pair of equal initials is legal
        last = r["initial"]
    costs, audits = solve(tuple(coded), (0,) if opens else (0, 1, 2, 3))
    return dict(ck=rows[0]["ck"], pid=TaskContext.get().partitionId(), seq=seq, blank=blank, duplicate=duplicate, truncated=truncated,
                illegal=illegal, first=rows[0]["initial"], last=last, low=turns[0] if turns else None, high=turns[-1] if turns else None,
                turns=len(turns), costs=costs, audits=audits)


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


_BLOCK_ARROW = pa.schema([("ck", pa.string()), ("pid", pa.int32()), *[(c, pa.int64()) for c in "seq blank duplicate truncated illegal".split()],
                          ("first", pa.string()), ("last", pa.string()), *[(c, pa.int64()) for c in "low high turns".split()],
                          ("costs", pa.list_(pa.int32())), ("audits", pa.list_(pa.string()))])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted rows: a block has rows of one conversation, and rows of a turn stay together where they fit."""
    def cut() -> Iterator[dict]:
        held: list[dict] = []
        before, seq = None, 0                                  # conversation of the block before; in a partition's first run it is not known
        for row in _rows(batches):
            if held and (row["ck"] != held[0]["ck"] or len(held) == BLOCK_ROWS):
                yield _block_of(held, seq, before is not None and before != held[0]["ck"])
                before, seq, held = held[0]["ck"], seq + 1, []
            held.append(row)
        if held:
            yield _block_of(held, seq, before is not None and before != held[0]["ck"])

    yield from _batched(cut(), _BLOCK_ARROW)


_PLAN = "ck string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_PLAN_ARROW = pa.schema([("ck", pa.string()), *[(c, pa.int64()) for c in "gaps blank duplicate truncated illegal cost".split()], ("audit", pa.string())])


def _plan_of(blocks: list[dict]) -> dict:
    cost, audit = joined([(b["costs"], b["audits"]) for b in blocks])
    timed = [b for b in blocks if b["turns"]]
    pairs = list(zip(blocks, blocks[1:]))
    turns = sum(b["turns"] for b in timed) - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
    return dict(ck=blocks[0]["ck"], gaps=timed[-1]["high"] - timed[0]["low"] + 1 - turns if timed else 0,
                illegal=sum(b["illegal"] for b in blocks) + sum(a["last"] + b["first"] not in LEGAL for a, b in pairs),
                cost=cost, audit=audit, **{k: sum(b[k] for b in blocks) for k in ("blank", "duplicate", "truncated")})


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def cut() -> Iterator[dict]:
        held: list[dict] = []
        for row in _rows(batches):
            if held and row["ck"] != held[0]["ck"]:
                yield _plan_of(held)
                held = []
            held.append(row)
        if held:
            yield _plan_of(held)

    yield from _batched(cut(), _PLAN_ARROW)


class _Repaired:
    """A conversation's edits applied to its rows as they come, into one digest."""

    def __init__(self, plan: dict) -> None:
        self.plan, self.sha, self.at, self.state, self.empty = plan, hashlib.sha256(), 0, 0, True
        self.audit = plan.get("audit") or ""

    def _write(self, initial: str, role: str, text: str) -> None:
        self.sha.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty, self.state = False, STEP[self.state, initial]

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            due = DUE[self.state]
            self._write(due, ROLES[due], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self._write(role[:1], role, text)
        elif letter == "R":
            due = DUE[self.state]
            self._write(due, ROLES[due], text)

    def result(self, conv) -> dict:
        self._inserted()
        return dict(conv_id=conv, **{k: self.plan.get(k) or 0 for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")},
                    audit=self.audit, repaired_sha256=self.sha.hexdigest())


def _conversation(conv_id: Column) -> Column:
    """The id as text that is never null and unlike for null and for every value."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def prepared(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """ck, turn, role, text and its digest; null roles and texts are one space."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" "))
    return rows.select(_conversation(F.col(f"`{conv_id}`")).alias("ck"), F.col(f"`{turn}`").cast("long").alias("turn"),
                       F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("role"), body.alias("text"),
                       F.unhex(F.sha2(body, 256)).alias("digest"))


def repair_plans(rows: DataFrame) -> DataFrame:
    """One row for each conversation of `prepared` rows: ck, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    kept = F.rtrim("text", F.lit(_BLANKS))
    slim = (rows.groupBy("ck", "turn", "role", "digest")
            .agg(F.count("*").alias("copies"), F.max(kept == "").alias("blank"), F.max(~F.right(kept, F.lit(1)).isin(".", "!", "?")).alias("truncated")))
    place = F.struct(F.col("turn").isNotNull().alias("told"), F.coalesce("turn", F.lit(0)).alias("turn"))
    again = (slim.groupBy("ck", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("places"))
             .where("places > 1").drop("places"))
    marked = slim.join(again, ["ck", "role", "digest"], "left").select(
        "ck", "turn", "role", "digest", "copies", "blank", "truncated", F.substring("role", 1, 1).alias("initial"),
        F.coalesce(place > F.col("first"), F.lit(False)).alias("repeat"))
    order = ["ck", F.col("turn").asc_nulls_first(), "role", "digest"]
    blocks = (marked.repartitionByRange(*order).sortWithinPartitions(*order)
              .select("ck", "turn", "copies", "blank", "truncated", "initial", "repeat").mapInArrow(_blocks, _BLOCK))
    return blocks.repartition("ck").sortWithinPartitions("ck", "pid", "seq").mapInArrow(_plans, _PLAN)


def repair(rows: DataFrame, every: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           with_text: bool = False) -> DataFrame:
    """One row for each conversation of `every` (a table with the id; by default `rows`): conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256.

    With `with_text`, the repaired rows instead: conv_id, at (0, 1, ...), role, text."""
    own = prepared(rows, conv_id, turn, role, text)
    ids = (rows if every is None else every).select(F.col(f"`{conv_id}`").alias("conv_id")).distinct()
    kind = ids.schema[0].dataType.simpleString()
    heads = ids.select(_conversation(F.col("conv_id")).alias("ck"), "conv_id", F.lit(0).alias("kind"))
    plans = repair_plans(own).withColumn("kind", F.lit(1))
    bodies = own.withColumn("kind", F.lit(2))
    order = ["ck", "kind", F.col("turn").asc_nulls_first(), "role", "digest"]
    met = (heads.unionByName(plans, allowMissingColumns=True).unionByName(bodies, allowMissingColumns=True)
           .repartition("ck").sortWithinPartitions(*order).drop("digest", "turn"))

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ck = conv = now = None
        at = 0
        for row in _rows(batches):
            if row["ck"] != ck:
                if now:
                    yield from _ended(now, conv, at)
                ck, conv, now, at = row["ck"], row["conv_id"], _Repaired({}), 0
            if row["kind"] == 1:
                now = (_Lines if with_text else _Repaired)(row)
            elif row["kind"] == 2:
                now.row(row["role"], row["text"])
            if with_text and row["kind"] == 2:
                for line in now.taken():
                    yield dict(conv_id=conv, at=at, **line)
                    at += 1
        if now:
            yield from _ended(now, conv, at)

    def _ended(now: _Repaired, conv, at: int) -> Iterator[dict]:
        done = now.result(conv)
        if not with_text:
            yield done
        elif isinstance(now, _Lines):
            for k, line in enumerate(now.taken()):
                yield dict(conv_id=conv, at=at + k, **line)

    names = [("at", pa.int64()), ("role", pa.string()), ("text", pa.string())] if with_text else [
        *[(c, pa.int64()) for c in "gaps blank duplicate truncated illegal cost".split()], ("audit", pa.string()), ("repaired_sha256", pa.string())]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("conv_id", first.schema.field("conv_id").type), *names])

        def all_batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        yield from _batched(repaired(all_batches()), schema)

    return met.mapInArrow(go, ", ".join([f"conv_id {kind}"] + [f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in names]))


class _Lines(_Repaired):
    """As above, with the repaired rows themselves."""

    def __init__(self, plan: dict) -> None:
        super().__init__(plan)
        self._held: list[dict] = []

    def _write(self, initial: str, role: str, text: str) -> None:
        self._held.append(dict(role=role, text=text))
        self.empty, self.state = False, STEP[self.state, initial]

    def taken(self) -> list[dict]:
        held, self._held = self._held, []
        return held


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults by crc32 of `conv_id:turn`: of 20, 0 drops the row, 1 empties its text, 2 removes its `.!?`, 3 repeats it, 4 makes it the user's.
    Nulls are one space, in the digest too, but ids and turns stay null."""
    def told(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(told(conv_id), F.lit(":"), told(turn)).cast("binary")) % 20
    body = F.when(fault == 1, "").when(fault == 2, F.translate(told(text), ".!?", "")).otherwise(told(text))
    made = rows.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), fault.alias("fault"),
                       F.when(fault == 4, "user").otherwise(told(role)).alias("role"), body.alias("text")).where("fault <> 0")
    return made.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("fault", "copy")
