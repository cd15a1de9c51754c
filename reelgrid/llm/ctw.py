"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions; a decision's context is the bits of the byte so far and the last 0 to DEPTH bytes. Each node
of the context tree has a Krichevsky-Trofimov estimate of its decision, and a node's weighted probability is half its own estimate
and half the product of its children's, so that all depths are mixed by how well they predicted the training texts. A
text is scored with the tree as trained: at each decision, the estimates of all depths are mixed by their posterior weights.

1. Texts are dealt by hash into blocks of about BLOCK_BYTES. A block gives its distinct byte grams (DEPTH bytes and the next one) and
   words with their counts in training texts.
2. Spark adds the counts up by gram, in ranges of the two nearest context bytes. All nodes of depth 2 and more below such a
   pair are worked out in one sorted stream; depths 0 and 1 (at most 65,536 sums) on the driver.
3. Each distinct gram gets its code length, which goes back to the blocks that hold the gram (a gram carries their numbers), and the
   texts are scored by look-up. No text is compared with a table larger than what its block holds.

The counts grow with the corpus and are never cut. Nulls: a null text is empty, a null id counts as the empty text, whose
checksum holds it out. Repeated rows are scored alike, and each trains. An empty table gives no rows; with no training text
every estimate is one half.
Long texts are taken whole; a block that holds one is larger. Other columns are not read, so their names do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from reelgrid.llm.texts import LOWER, columns, row_key, written

DEPTH = 5
BLOCK_BYTES = 16 << 20
SLICE = 1 << 19
#: Rows of one Arrow batch of counts.
BATCH = 200_000

_HALF = math.log(0.5)
#: log Gamma(n + 1/2) and log Gamma(n + 1) at whole n below 256.
_LOG_HALVES = np.array([math.lgamma(n + 0.5) for n in range(256)])
_LOG_WHOLES = np.array([math.lgamma(n + 1.0) for n in range(256)])


def _log_gamma(n: np.ndarray, add: float, table: np.ndarray) -> np.ndarray:
    """log Gamma(n + add) for whole n: a table, then Stirling's series."""
    x = np.maximum(n, 200) + add
    far = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x ** 3)
    return np.where(n < 256, table[np.minimum(n, 255)], far)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return (_log_gamma(a, 0.5, _LOG_HALVES) + _log_gamma(b, 0.5, _LOG_HALVES)
            - math.log(math.pi) - _log_gamma(a + b, 1.0, _LOG_WHOLES))


def gram_keys(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all coded bytes, coded bytes of each text): nearest context byte on top, the coded byte last; a zero byte ends a text."""
    pad = b"\0" * depth
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\0")), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    keys = data.astype(np.int64)
    for j in range(1, depth + 1):
        keys[j:] |= data[:-j].astype(np.int64) << (8 * (depth - j + 1))
    coded = np.ones(len(data), bool)
    starts = np.cumsum(np.append(0, sizes[:-1] + depth))
    for j in range(depth):
        coded[starts + j] = False
    return keys[coded], sizes


def _slices(texts: list[bytes]) -> Iterator[list[int]]:
    part, size = [], 0
    for i, t in enumerate(texts):
        part.append(i)
        size += len(t)
        if size > SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def block_counts(texts: list[bytes], train: list[bool], depth: int) -> tuple[np.ndarray, np.ndarray, list[bytes], list[int]]:
    """(grams, their training counts, words, their training counts), grams and words distinct and sorted."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0)]
    words: Counter = Counter()

    def merge() -> None:
        # sorted sums, without the inverse of a unique, which takes as much memory again
        rows = np.concatenate(keys)
        keys.clear()
        order = np.argsort(rows)
        rows = rows[order]
        at = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])[:len(rows)])
        keys.append(rows[at])
        del rows
        n = np.concatenate(counts)[order]
        counts[:] = [_sums(n, at) if len(at) else n]
    for part in _slices(texts):
        some = [texts[i].translate(LOWER) for i in part]
        k, sizes = gram_keys(some, depth)
        coded = pa.array(k).dictionary_encode()
        keys.append(coded.dictionary.to_numpy())
        use = np.repeat([train[i] for i in part], sizes)
        counts.append(np.bincount(coded.indices.to_numpy()[use], minlength=len(keys[-1])))
        if len(keys) > 8:
            merge()
        for t, i in zip(some, part):
            found = t.split()
            words.update(found if train[i] else dict.fromkeys(found, 0))
    merge()
    order = sorted(words)
    return keys[0], counts[0].astype(np.int64), order, [words[w] for w in order]


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, at)


class Levels:
    """Nodes of the depths from DEPTH down to 2 for all grams of some pairs of nearest bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int) -> None:
        byte = keys & 255
        #: probabilities of the eight decisions of each gram, mixed up to depth 2
        self.p = np.full((len(keys), 8), 0.5)
        #: sums for depth 1: nearest byte and prefix -> log weighted probability
        self.up_keys: list[np.ndarray] = []
        self.up_logs: list[np.ndarray] = []
        for j in range(8):
            bit = (byte >> (7 - j)) & 1
            logs = child = None
            for d in range(depth, 1, -1):
                node = ((keys >> (8 * (depth - d + 1))) << j) | (byte >> (8 - j))
                order = np.argsort(node, kind="stable")
                at = np.flatnonzero(np.append(True, node[order][1:] != node[order][:-1]))
                of = np.empty(len(keys), np.int64)
                of[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(keys))))
                ones = np.bincount(of, weights=counts * bit, minlength=len(at)).astype(np.int64)
                zeros = np.bincount(of, weights=counts * (1 - bit), minlength=len(at)).astype(np.int64)
                own = log_kt(zeros, ones)
                p = (np.where(bit == 1, ones[of], zeros[of]) + 0.5) / (zeros + ones + 1)[of]
                if child is None:
                    logs, mixed = own, p
                else:
                    below = np.zeros(len(at))
                    first = np.empty(len(logs), np.int64)
                    first[child] = of                  # the parent of each child node
                    np.add.at(below, first, logs)
                    logs = np.logaddexp(_HALF + own, _HALF + below)
                    w = np.exp(_HALF + own - logs)[of]
                    mixed = w * p + (1 - w) * mixed
                child = of
            self.p[:, j] = mixed
            nodes = np.zeros(len(logs), np.int64)
            nodes[child] = ((keys >> (8 * depth)) << 8) | (1 << j) | (byte >> (8 - j))
            self.up_keys.append(nodes)
            self.up_logs.append(logs)


def _tree_rows(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Sorted (key, n, block) -> kind 0: gram with its probabilities and its blocks; 1: count by nearest byte and byte; 2: log sum by nearest
    byte and prefix."""
    names = ["kind", "key", "v", "p", "blocks"]

    def made(keys: np.ndarray, n: np.ndarray, blocks: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        held = pa.ListArray.from_arrays(pa.array(np.append(at, len(keys)).astype(np.int32)), pa.array(blocks.astype(np.int32)))
        keys, n = keys[at], _sums(n, at)
        tree = Levels(keys, n, depth)
        m = len(keys)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.array(keys), pa.nulls(m, pa.float64()),
                                          pa.array([x.tobytes() for x in tree.p], pa.binary()), held], names=names)
        for kind, k, v in ((1, ((keys >> (8 * depth)) << 8) | (keys & 255), n.astype(float)),
                           (2, np.concatenate(tree.up_keys), np.concatenate(tree.up_logs))):
            u, of = np.unique(k, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u), pa.array(np.bincount(of, weights=v)),
                                              pa.nulls(len(u), pa.binary()), pa.nulls(len(u), pa.list_(pa.int32()))], names=names)
    shift = 8 * (depth - 1)
    rows = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        rows = [np.concatenate((x, batch.column(i).to_numpy(zero_copy_only=False))) for i, x in enumerate(rows)]
        if not len(rows[0]):
            continue
        whole = int(np.searchsorted(rows[0] >> shift, rows[0][-1] >> shift))
        if whole:
            yield from made(*(x[:whole] for x in rows))
            rows = [x[whole:] for x in rows]
    if len(rows[0]):
        yield from made(*rows)


def top_levels(counts: dict[int, float], logs: dict[int, float]) -> tuple[np.ndarray, ...]:
    """(weight, probability of a one) at depth 1, by nearest byte and prefix, and at depth 0, by prefix."""
    n = np.zeros((256, 256), np.int64)
    below = np.zeros((256, 256))
    for k, v in counts.items():
        n[k >> 8, k & 255] = round(v)
    for k, v in logs.items():
        below[k >> 8, k & 255] = v

    def level(n: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        zeros, ones = np.zeros_like(below, np.int64), np.zeros_like(below, np.int64)
        for j in range(8):
            for prefix in range(1 << j):
                span = n[..., prefix << (8 - j):(prefix + 1) << (8 - j)]
                half = span.shape[-1] // 2
                zeros[..., 1 << j | prefix] = span[..., :half].sum(-1)
                ones[..., 1 << j | prefix] = span[..., half:].sum(-1)
        own = log_kt(zeros, ones)
        log = np.logaddexp(_HALF + own, _HALF + below)
        return np.exp(_HALF + own - log), (ones + 0.5) / (zeros + ones + 1), log
    w1, p1, log1 = level(n, below)
    w0, p0, _ = level(n.sum(0), log1.sum(0))
    return w1, p1, w0, p0


def train(counted: DataFrame, depth: int) -> DataFrame:
    """(key, log10, blocks): the log10 probability of each distinct gram's byte, and the blocks that hold the gram, from (key, n, block)."""
    ranges = counted.repartition(F.shiftright("key", 8 * (depth - 1))).sortWithinPartitions("key")
    rows = written(ranges.mapInArrow(lambda b: _tree_rows(b, depth), "kind int, key long, v double, p binary, blocks array<int>"), "ctw-nodes", "zstd")
    sums = rows.where("kind > 0").groupBy("kind", "key").agg(F.sum("v").alias("v")).collect()
    top = top_levels({r["key"]: r["v"] for r in sums if r["kind"] == 1}, {r["key"]: r["v"] for r in sums if r["kind"] == 2})
    shared = counted.sparkSession.sparkContext.broadcast(top)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w1, p1, w0, p0 = shared.value
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            p = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, 8)
            near, byte, total = keys >> (8 * depth), keys & 255, np.zeros(len(keys))
            for j in range(8):
                bit, prefix = (byte >> (7 - j)) & 1, (1 << j) | (byte >> (8 - j))
                q = p[:, j]
                for w, one in ((w1[near, prefix], p1[near, prefix]), (w0[prefix], p0[prefix])):
                    q = w * np.where(bit == 1, one, 1 - one) + (1 - w) * q
                total += np.log10(q)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total), batch.column(2)], names=["key", "log10", "blocks"])

    return rows.where("kind = 0").select("key", "p", "blocks").mapInArrow(go, "key long, log10 double, blocks array<int>")


def held_out(doc_id: Column, folds: int = 10) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte: one row a document."""
    if not 2 <= depth <= 6:
        raise ValueError("depth is 2 to 6 bytes")
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    n_blocks = max(1, math.ceil(size / block_bytes))
    src = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("binary").alias("text"),
                      F.pmod(row_key(F.col(doc_id), F.col(text)), F.lit(n_blocks)).cast("int").alias("block"))

    def texts_of(table: pa.Table) -> tuple[list[bytes], list[bool]]:
        return [x or b"" for x in table.column("text").to_pylist()], table.column("held_out").to_pylist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted blocks -> their grams, then their words, in batches; one block of text is held."""
        block, texts, use = None, [], []

        def told() -> Iterator[pa.RecordBatch]:
            grams, n, words, w = block_counts(texts, use, depth)
            m, k = len(grams), len(words)
            for i in range(0, m, BATCH):
                size = min(BATCH, m - i)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, block, np.int32)), pa.array(grams[i:i + size]), pa.nulls(size, pa.binary()),
                                                  pa.nulls(size, pa.int32()), pa.array(n[i:i + size])], names=names)
            for i in range(0, k, BATCH):
                size = min(BATCH, k - i)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, block, np.int32)), pa.nulls(size, pa.int64()), pa.array(words[i:i + size], pa.binary()),
                                                  pa.array(range(i, i + size), pa.int32()), pa.array(w[i:i + size], pa.int64())], names=names)

        names = ["block", "key", "word", "idx", "n"]
        for batch in batches:
            for of, body, out in zip(*columns(batch, "block", "text", "held_out")):
                if of != block:
                    if texts:
                        yield from told()
                    block, texts, use = of, [], []
                texts.append(body or b"")
                use.append(not out)
        if texts:
            yield from told()

    placed = src.select("block", "held_out", "text").repartition("block").sortWithinPartitions("block")
    counted = written(placed.mapInArrow(count, "block int, key long, word binary, idx int, n long"), "ctw-counts", "zstd")
    grams = counted.where("key is not null").select("key", "n", "block")
    # one narrow row for each answer: k is the gram, or -1 - 2 * word number - (the word's first block), v its log10 or count
    lengths = train(grams, depth).select(F.explode("blocks").alias("block"), F.col("key").alias("k"), F.col("log10").alias("v"))
    same = W.partitionBy("word")
    first = (F.min("block").over(same) == F.col("block")).cast("long")
    known = counted.where("word is not null").select("block", (-1 - 2 * F.col("idx").cast("long") - first).alias("k"),
                                                     F.sum("n").over(same).cast("double").alias("v"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def rate(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts, out = texts_of(table)
        k, v = answers.column("k").to_numpy(), answers.column("v").to_numpy()
        words = -1 - k[k < 0]
        counts = np.zeros(len(words), np.int64)
        counts[words >> 1] = v[k < 0]
        fresh = int(((words & 1 == 1) & (v[k < 0] > 0)).sum())
        gram = k >= 0
        keys, logs = k[gram], v[gram]
        del k, v, gram
        order = np.argsort(keys)
        keys, logs = keys[order], logs[order]
        del order
        vocabulary: set[bytes] = set()
        for t in texts:
            vocabulary.update(t.translate(LOWER).split())
        c = dict(zip(sorted(vocabulary), counts.tolist()))
        part, n_tokens, n_known = [], [], []
        logged = {n: math.log10(n + 0.1) for n in set(counts.tolist())}
        for t in texts:
            found = [c[x] for x in t.translate(LOWER).split()]
            part.append(math.fsum(logged[n] for n in found))
            n_tokens.append(len(found) + 1)
            n_known.append(len(found) - found.count(0))
        scores = np.zeros(len(texts))
        for some in _slices(texts):
            k, sizes = gram_keys([texts[i].translate(LOWER) for i in some], depth)
            coded = pa.array(k).dictionary_encode()              # its few distinct grams are sought, so no table of all is built
            at = np.searchsorted(keys, coded.dictionary.to_numpy())
            scores[some] = np.add.reduceat(logs[at][coded.indices.to_numpy()], np.cumsum(np.append(0, sizes[:-1])))
        return pa.table({"doc_id": table.column("doc_id"), "held_out": table.column("held_out"),
                         "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                         "part": pa.array(part, pa.float64()), "score": pa.array(scores), "n_bytes": pa.array([len(t) + 1 for t in texts], pa.int64()),
                         "fresh": pa.array([fresh] + [0] * (len(texts) - 1), pa.int64())})

    rated = written(src.groupBy("block").cogroup(lengths.unionByName(known).groupBy("block")).applyInArrow(
        rate, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, part double, score double, n_bytes long, fresh long"), "ctw-scores")
    trained = ~F.col("held_out")
    t = rated.agg(F.coalesce(F.sum(F.when(trained, F.col("n_tokens"))), F.lit(0)).alias("tokens"), F.count_if(trained).alias("ends"),
                  F.coalesce(F.sum("fresh"), F.lit(0)).alias("words")).first()
    tokens, ends, distinct = t["tokens"], t["ends"], t["words"] + (t["ends"] > 0)
    base = (F.col("part") + F.lit(math.log10(ends + 0.1)) - F.col("n_tokens") * F.lit(math.log10(tokens + 0.1 * (distinct + 1))))
    return rated.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"),
                        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
                        (-F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
