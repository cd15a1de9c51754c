"""Substring dedup by recompression: equal passages get equal interior symbols, which reveal long repeats.

1. Words are symbols. In each round the symbols are split into a left and a right half by their names, and each left
   symbol followed by a right one becomes one symbol, named by a hash of the two names: a name is global, since it depends on
   the content alone, and needs no table. Equal neighbours never pair, so a run stays a run of equal symbols and
   may be cut anywhere by a window. After ROUNDS rounds a symbol has at most 2^ROUNDS words and depends on no more than MARGIN words
   beside it, so all equal windows of the text have equal symbols in their interior.
2. Each window is put down to the symbol of the smallest name in its interior, its anchor. The windows of one anchor are a block. Two
   equal windows have equal words from MARGIN before their anchors on, which is the block's fingerprint.
3. Spark brings equal fingerprints together. A fingerprint met once holds no repeat. A block that equals an earlier block is covered
   as a whole. Where unequal blocks share a fingerprint, the first of each kind is taken apart: its windows are
   compared one by one, by hashes of all their words. The first place of any window lies in a first block, so nothing is lost.
4. Covered ranges meet the texts, whose uncovered words stay.

Blocks that repeat inside a batch are settled there, so that a fingerprint brings at most one row of each kind from a batch.

Nulls: a null text has no words; a null id counts as the smallest. Rows of the same id are ordered by a hash of id and text, and equal
rows are one document: a row is no repeat of its equal. Texts shorter than a window lose nothing. An empty table gives no rows.
Long texts are taken whole. Other columns are not read, so their names do not matter. Ids are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from reelgrid.llm.texts import columns, row_key, written

ROUNDS = 2
MARGIN = 3
#: Words of a slice that is worked on at a time.
SLICE = 400_000

_U = np.uint64
_LOWEST = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class Words:
    """Hashes of words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        h = self.known.get(word)
        if h is None:
            if len(self.known) > 500_000:
                self.known.clear()
            h = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self._hash, words), _U, len(words))


class Spans:
    """Hashes of any span of words from prefix sums."""

    def __init__(self, h: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            n = len(h)
            power = np.full(n + 1, _BASE, _U)
            self.back = np.full(n + 1, _BACK, _U)
            power[0] = self.back[0] = 1
            np.cumprod(power, out=power)
            np.cumprod(self.back, out=self.back)
            self.sums = np.concatenate((np.zeros(1, _U), np.cumsum(h * power[:n], dtype=_U)))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(_U))


def symbols(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, first word) of the symbols after all rounds; a symbol stays inside its document."""
    name, start = h, np.arange(len(h))
    for r in range(ROUNDS):
        right = (_mix(name + _U(r + 1)) & _U(1)).astype(bool)
        pair = np.zeros(len(name), bool)
        pair[:-1] = ~right[:-1] & right[1:] & (doc[start[:-1]] == doc[start[1:]])
        second = np.concatenate(([False], pair[:-1]))
        with np.errstate(over="ignore"):
            joined = _mix(name[:-1] * _U(_BASE) + _mix(name[1:] + _U(r + 1)))
        name = np.where(pair, np.append(joined, _U(0)), name)[~second]
        start = start[~second]
    return name, start


def blocks(h: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, fingerprint, content hash) of the blocks of several documents in a row."""
    none = np.zeros(0, np.int64)
    n = len(h)
    if n < window:
        return none, none, none, none.astype(_U), none.astype(_U)
    name, start = symbols(h, doc)
    low, high = MARGIN, window - MARGIN - (1 << ROUNDS)
    rank = np.full(n, ~_U(0))
    rank[start] = name >> _U(1)
    m = n - window + 1
    best = rank[low:low + m].copy()
    for o in range(low + 1, high + 1):
        np.minimum(best, rank[o:o + m], out=best)
    anchor = np.zeros(m, np.int64)
    at = np.arange(m)
    for o in range(high, low - 1, -1):
        same = rank[o:o + m] == best
        anchor[same] = at[same] + o
    inside = doc[:m] == doc[window - 1:]
    new = np.ones(m, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    after = np.flatnonzero(np.append(new | ~inside, True))
    last = after[np.searchsorted(after, first, side="right")] - 1
    a = anchor[first]
    spans = Spans(h)
    # all windows of an anchor hold the words from MARGIN before it to window - high after it
    mark = spans(a - low, a + (window - high))
    return first, last, a, mark, spans(first, last + window) ^ _mix((a - first).astype(_U))


def _merged(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching ranges of a key as one; rows in the order of key and a, b rising with a."""
    if not len(key):
        return key, a, b
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (a[1:] > b[:-1])
    at = np.flatnonzero(new)
    return key[at], a[at], b[np.append(at[1:], len(key)) - 1]


_ROWS = ["fp", "content", "doc", "rk", "a", "b", "s"]


def block_rows(docs: DataFrame, window: int) -> DataFrame:
    """Rows of blocks (fp, content, doc, rk, a and b: first and last window, s: anchor), and of settled ranges (content null, a to b)."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words()
        for batch in batches:
            docs_, rks, bodies = columns(batch, "doc", "rk", "text")
            docs_, rks = np.array(docs_, np.int64), np.array(rks, np.int64)
            parts: list[tuple] = []
            hs: list[np.ndarray] = []
            size = 0

            def flush() -> None:
                lengths = [len(h) for _, h in hs]
                owner = np.repeat([i for i, _ in hs], lengths)
                offset = np.repeat(np.cumsum([0, *lengths[:-1]]), lengths)
                first, last, s, mark, content = blocks(np.concatenate([h for _, h in hs]), owner, window)
                parts.append((owner[first], first - offset[first], last - offset[first], s - offset[first], mark, content))
            for i, body in enumerate(bodies):
                words = (body or b"").split()
                if len(words) < window:
                    continue
                hs.append((i, hashed(words)))
                size += len(words)
                if size > SLICE:
                    flush()
                    hs, size = [], 0
            if hs:
                flush()
            if not parts:
                continue
            row, a, b, s, mark, content = (np.concatenate(x) for x in zip(*parts))
            doc, rk = docs_[row], rks[row]
            order = np.lexsort((a, rk, doc, content, mark))
            row, a, b, s, mark, content, doc, rk = (x[order] for x in (row, a, b, s, mark, content, doc, rk))
            new = np.ones(len(a), bool)
            new[1:] = (content[1:] != content[:-1]) | (mark[1:] != mark[:-1])
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            settled = ~new & ~((doc == doc[head]) & (rk == rk[head]) & (a == a[head]))
            yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (mark.view(np.int64), content.view(np.int64), doc, rk)]
                                             + [pa.array(x[new], pa.int32()) for x in (a, b, s)], names=_ROWS)
            row, a, b = row[settled], a[settled], b[settled] + window
            order = np.lexsort((a, row))
            row, a, b = _merged(row[order], a[order], b[order])
            spread = _mix(rks[row].view(_U)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.nulls(len(row), pa.int64()), pa.array(docs_[row]), pa.array(rks[row]),
                                              pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.nulls(len(row), pa.int32())], names=_ROWS)

    return docs.mapInArrow(go, "fp long, content long, doc long, rk long, a int, b int, s int")


def settled_blocks(rows: DataFrame, window: int) -> DataFrame:
    """Covered ranges (s null, a to b) and the first blocks that have to be taken apart (fp, doc, rk, a, b, s)."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp = content = first = None
        several = False
        for batch in batches:
            out: list[tuple] = []
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            edge = np.ones(len(fps) + 1, bool)
            edge[1:-1] = fps[1:] == fps[:-1]
            open_ = edge[:-1] | edge[1:] | batch.column(1).is_null().to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array(open_))
            for f, c, doc, rk, a, b, s in zip(*columns(some, *_ROWS)):
                if c is None:
                    out.append((None, doc, rk, a, b, None))
                    continue
                if f != fp:
                    fp, content, first, several = f, c, (f, doc, rk, a, b, s), False
                    continue
                if c != content:
                    if not several:
                        out.append(first)
                        several = True
                    content, first = c, (f, doc, rk, a, b, s)
                    out.append(first)
                elif (doc, rk, a) != first[1:4]:
                    out.append((None, doc, rk, a, b + window, None))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.int32()] * 3)],
                                                 names=["fp", "doc", "rk", "a", "b", "s"])

    placed = rows.repartition("fp").sortWithinPartitions("fp", "content", "doc", "rk", "a")
    return placed.mapInArrow(go, "fp long, doc long, rk long, a int, b int, s int")


def repeated_windows(apart: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """(doc, rk, a, b) of the windows of taken-apart blocks that start earlier elsewhere."""
    asked = apart.groupBy("doc", "rk").agg(F.collect_list(F.struct("fp", "a", "b", "s")).alias("blocks"))
    met = texts.join(asked, ["doc", "rk"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words()
        for batch in batches:
            made: list[tuple] = []
            for doc, rk, body, parts in zip(*columns(batch, "doc", "rk", "text", "blocks")):
                spans = Spans(hashed((body or b"").split()))
                first = np.array([p["a"] for p in parts])
                count = np.array([p["b"] for p in parts]) - first + 1
                p = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                fp = np.repeat(np.array([x["fp"] for x in parts], np.int64), count)
                made.append((spans(p, p + window).view(np.int64), fp, np.full(len(p), doc), np.full(len(p), rk), p))
            if made:
                w, fp, doc, rk, p = (np.concatenate(x) for x in zip(*made))
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(fp), pa.array(doc), pa.array(rk), pa.array(p, pa.int32())],
                                                 names=["w", "fp", "doc", "rk", "a"])

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple | None = None
        for batch in batches:
            w, fp, doc, rk, a = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(w):
                continue
            head = np.ones(len(w), bool)
            head[1:] = (w[1:] != w[:-1]) | (fp[1:] != fp[:-1])
            head[0] = first is None or (w[0], fp[0]) != first[:2]
            at = np.flatnonzero(head)[np.maximum(np.cumsum(head) - 1, 0)] if head.any() else np.zeros(len(w), np.int64)
            same = ~head & (doc == doc[at]) & (rk == rk[at]) & (a == a[at])
            lead = np.cumsum(head) == 0               # rows whose first one was in an earlier batch
            if lead.any():
                same[lead] = (doc[lead] == first[2]) & (rk[lead] == first[3]) & (a[lead] == first[4])
            if head.any():
                k = np.flatnonzero(head)[-1]
                first = (w[k], fp[k], doc[k], rk[k], a[k])
            use = ~head & ~same
            yield pa.RecordBatch.from_arrays([pa.array(doc[use]), pa.array(rk[use]), pa.array(a[use], pa.int32()), pa.array(a[use] + window, pa.int32())],
                                             names=["doc", "rk", "a", "b"])

    rows = met.mapInArrow(windows, "w long, fp long, doc long, rk long, a int")
    return rows.repartition("w").sortWithinPartitions("w", "fp", "doc", "rk", "a").mapInArrow(later, "doc long, rk long, a int, b int")


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text on demand): one row a document."""
    if window < 2 * MARGIN + 2 * (1 << ROUNDS):
        raise ValueError("a window is too short for a symbol in its interior")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_LOWEST)).alias("doc"),
                        row_key(F.col(doc_id), F.col(text)).alias("rk"), F.col(text).cast("binary").alias("text"))
    found = written(settled_blocks(block_rows(texts.drop("doc_id"), window), window), "repeats")
    late = repeated_windows(found.where("s is not null"), texts, window)
    ranges = found.where("s is null").select("doc", "rk", "a", "b").unionByName(late)
    covered = ranges.groupBy("doc", "rk").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    met = texts.join(covered, ["doc", "rk"], "left")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, parts in zip(*columns(batch, "text", "ranges")):
                words = (body or b"").split()
                kept = words
                if parts:
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, [p["a"] for p in parts], 1)
                    np.add.at(depth, [p["b"] for p in parts], -1)
                    kept = [w for w, d in zip(words, np.cumsum(depth).tolist()) if not d]
                stay = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(stay).hexdigest(), stay if with_text else None))
            made = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id"))]
                                             + [pa.array(v, t) for v, t in zip(made, (pa.int64(), pa.int64(), pa.string(), pa.binary()))],
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    out = met.mapInArrow(go, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text binary")
    return out.withColumn("kept_text", F.col("kept_text").cast("string")) if with_text else out.drop("kept_text")
