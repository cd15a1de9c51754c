"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items are normalised, cut into pieces (with an overlap of a window less one word, so that no window is lost) and dealt
into blocks of a bounded number of words. One automaton holds the pieces of a block; document words are streamed through it,
and the length of the longest suffix that occurs in an item is tracked word by word. From a length of one window on, all
words of the match are hit; items shorter than a window count when they occur whole. A block's pieces are the only
data on the driver and in a broadcast, and their size is bounded by BLOCK_WORDS. Further blocks pass over the result of the earlier ones.

Nulls: a null text or item text has no words; a null item id is left out of `items_sha256` but its windows hit. Rows are
scanned one by one, so ties, repeated rows and null ids need no care. With an empty benchmark nothing is hit.
Long texts are taken whole. An empty table of documents gives no rows, an empty table of items hits nothing. Other columns keep
their names, whatever they are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reelgrid.llm.texts import WORD_BYTES, columns, each, written

#: Words of the items that one automaton takes: about 300,000 states.
BLOCK_WORDS = 200_000
PIECE_WORDS = 20_000


class Automaton:
    """Suffix automaton of several token lists, with what the scan asks of each state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, tokens in coded:
            at = 0
            for tok in tokens:
                at = self._extend(at, tok)
        #: state of a window -> the items that hold it; state -> short items that end there, with their lengths
        self.holders: dict[int, set] = {}
        self.short: dict[int, set] = {}
        for name, tokens in coded:
            at = 0
            for n, tok in enumerate(tokens, 1):
                at = self.next[at][tok]
                if n >= window:
                    self.holders.setdefault(self.window_state(at), set()).add(name)
            if len(tokens) < window:
                self.short.setdefault(at, set()).add((len(tokens), name))
        # states from which the links lead to a short item: links lead to shorter states
        self.near_short = [False] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.near_short[s] = s in self.short or (self.link[s] >= 0 and self.near_short[self.link[s]])

    def _state(self, moves: dict[int, int], link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, tok: int) -> int:
        """The state of p's longest string with `tok`: p's move if it is exact, else a new state cut off from it."""
        q, want = self.next[p][tok], self.length[p] + 1
        if self.length[q] == want:
            return q
        new = self._state(dict(self.next[q]), self.link[q], want)
        self.link[q] = new
        while p >= 0 and self.next[p].get(tok) == q:
            self.next[p][tok] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, tok: int) -> int:
        if tok in self.next[last]:
            return self._split(last, tok)
        new = self._state({}, 0, self.length[last] + 1)
        p = last
        while p >= 0 and tok not in self.next[p]:
            self.next[p][tok] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, tok)
        return new

    def window_state(self, s: int) -> int:
        """The state that holds the last `window` words of a match in state s."""
        while self.length[self.link[s]] >= self.window:
            s = self.link[s]
        return s

    def scan(self, words: list[bytes], hit: bytearray) -> set:
        """Marks the hit words in `hit` and returns the items with an occurring window."""
        found: set = set()
        nexts, links, lengths, near, window = self.next, self.link, self.length, self.near_short, self.window
        s = n = 0
        for i, tok in enumerate(map(self.ids.get, words)):
            if tok is None:
                s = n = 0
                continue
            to = nexts[s].get(tok)
            while to is None and s:
                s = links[s]
                n = lengths[s]
                to = nexts[s].get(tok)
            s, n = to, n + 1                           # the root knows every token of the items
            if n >= window:
                hit[i - n + 1:i + 1] = b"\1" * n
                found |= self.holders[self.window_state(s)]
            if near[s]:
                t = s
                while t > 0 and near[t]:
                    for size, name in self.short.get(t, ()):
                        if size <= n:
                            hit[i - size + 1:i + 1] = b"\1" * size
                            found.add(name)
                    t = links[t]
        return found


def pieces(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item, words, n): the items' normalised words, long items in overlapping pieces."""
    src = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("binary").alias("text"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, body in zip(*columns(batch, "item", "text")):
                words = (body or b"").translate(WORD_BYTES).split()
                for at in range(0, max(len(words) - window + 1, 1) if words else 0, PIECE_WORDS):
                    part = words[at:at + PIECE_WORDS + window - 1]
                    rows.append((name, b" ".join(part), len(part)))
            made = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, (pa.string(), pa.binary(), pa.int64()))],
                                             names=["item", "words", "n"])

    return src.mapInArrow(go, "item string, words binary, n long")


_CACHE: dict = {}


def _automaton(shared, window: int) -> Automaton:
    """Built once for each block that a Python worker meets in a row."""
    value = shared.value
    if _CACHE.get("of") is not value:
        _CACHE.update(of=value, machine=Automaton(value, window))
    return _CACHE["machine"]


def blocks(items: DataFrame, item_id: str, text: str, window: int) -> Iterator[tuple[bool, object]]:
    """(is it the last, broadcast of its pieces) for each block of the items."""
    spark = items.sparkSession
    parts = written(pieces(items, item_id, text, window), "benchmark-pieces")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    n = max(1, math.ceil(total / BLOCK_WORDS))
    parts = parts.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n)))
    for b in range(n):
        rows = parts.where(F.col("block") == b).select("item", "words").collect()
        yield b + 1 == n, spark.sparkContext.broadcast([(r["item"], bytes(r["words"]).split()) for r in rows])


def marked(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, window: int) -> DataFrame:
    """docs with `__hits` (one byte a word, null if none is hit) and `__items` (array of item ids)."""
    df = docs.withColumn("__hits", F.lit(None).cast("binary")).withColumn("__items", F.array().cast("array<string>"))
    schema = df.schema
    for last, held in blocks(items, item_id, item_text, window):
        def go(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            machine = _automaton(held, window)
            for batch in batches:
                hits, names = [], []
                for body, before, known in zip(*columns(batch, text, "__hits", "__items")):
                    words = (body or "").encode().translate(WORD_BYTES).split()
                    hit = bytearray(before or len(words))
                    found = machine.scan(words, hit)
                    hits.append(bytes(hit) if 1 in hit else None)
                    names.append(sorted({*known, *(x for x in found if x is not None)}))
                yield _replaced(batch, {"__hits": pa.array(hits, pa.binary()), "__items": pa.array(names, pa.list_(pa.string()))})

        df = df.mapInArrow(go, schema)
        if not last:
            df = written(df, "benchmark-marks")
    return df


def _replaced(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([new.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)


def report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    got = marked(src, items, "__text", item_id, item_text, window)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hit, count, sha = [], [], [], []
            for body, hits, names in zip(*columns(batch, "__text", "__hits", "__items")):
                n.append(len((body or "").encode().translate(WORD_BYTES).split()))
                hit.append((hits or b"").count(1))
                count.append(len(names))
                sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()),
                 pa.array([x > 0 for x in hit], pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return got.mapInArrow(go, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def without_spans(text: str, hits: bytes) -> str:
    """The text without its hit words and what stands between two of them."""
    data = text.encode()
    clean = np.frombuffer(data.translate(WORD_BYTES), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], clean.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bad = np.frombuffer(hits, np.uint8) == 1
    out, at, i = [], 0, 0
    while i < len(bad):
        if bad[i]:
            j = i
            while j + 1 < len(bad) and bad[j + 1]:
                j += 1
            out.append(data[at:starts[i]])
            at = int(ends[j])
            i = j
        i += 1
    out.append(data[at:])
    return b"".join(out).decode()


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """The columns of `docs`: hit spans are cut out, and documents that lose a larger share of words than `max_coverage` go.

    Cutting can bring words together that form a window again, so a text is cut until nothing is hit; with several blocks the
    passes over all blocks are repeated until one cuts nothing.
    """
    # numbered names inside, so that no name of the documents clashes
    cols = docs.columns
    text = f"c{cols.index(text)}"
    df = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(each(cols))], F.lit(0).cast("long").alias("cut"), F.lit(-1).cast("long").alias("words"))
    schema, before = df.schema, None
    while True:
        n = 0
        for last, held in blocks(items, item_id, item_text, window):
            def go(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                machine = _automaton(held, window)
                for batch in batches:
                    rows = [_cut(machine, *row) for row in zip(*columns(batch, text, "cut", "words"))]
                    made = list(zip(*rows)) if rows else [()] * 3
                    yield _replaced(batch, {text: pa.array(made[0], pa.string()), "cut": pa.array(made[1], pa.int64()),
                                            "words": pa.array(made[2], pa.int64())})

            df, n = df.mapInArrow(go, schema), n + 1
            if not last:
                df = written(df, "benchmark-cuts")
        if n == 1:
            break
        df = written(df, "benchmark-cuts")
        now = df.agg(F.sum("cut").alias("n")).first()["n"]
        if now == before or not now:
            break
        before = now
    return df.where(F.col("cut") <= F.lit(max_coverage) * F.col("words")).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])


def _cut(machine: Automaton, text: str | None, cut: int, total: int) -> tuple[str | None, int, int]:
    """(text without hits, words cut so far, words at first)."""
    while True:
        words = (text or "").encode().translate(WORD_BYTES).split()
        total = len(words) if total < 0 else total
        hit = bytearray(len(words))
        machine.scan(words, hit)
        if 1 not in hit:
            return text, cut, total
        cut += hit.count(1)
        text = without_spans(text, bytes(hit))
