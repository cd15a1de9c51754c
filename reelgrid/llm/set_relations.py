"""N-gram Jaccard join with set relations: exact links between documents by their sets of word shingles.

1. Documents with equal sets form a class; everything after that is about classes.
2. Prefix filter: the shingles of a set are ordered by rarity (a count sketch over all documents, then the hash), and only the
   first ones are indexed. Two linked sets share COMMON of them (fewer for tiny sets). A long index list is a group of its own.
   Short lists give their pairs of fitting sizes, and pairs with enough common shingles make further groups. Two linked sets share a
   long list or enough short ones, so every link is inside a group; it is counted in the first group that holds it.
3. A group is dealt into blocks of about BLOCK_SHINGLES, and each pair of blocks is one task. There the sets are in the order of
   size, an index list is entered at the position from which sizes can fit, and the counts of a set are derived from
   those of the set before it: only the shingles in which the two differ are counted anew.
4. A task returns link counts and a spanning forest of its links, never its pairs. Components join the forests.

Nulls: a null text has an empty set, which is linked with nothing; a null id never becomes a component id unless the component has no
other. Repeated rows are documents of one class. An empty table gives no rows.
Long texts are taken whole. Other columns are not read, or travel in a struct, so their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from reelgrid.llm.components import components, starred
from reelgrid.llm.texts import LOWER, columns, each, row_key, written

#: Index shingles that two linked sets have in common at least (tiny sets: all that they need).
COMMON = 4
#: Longest index list of which all pairs are listed.
SHORT_LIST = 32
#: Counters of the sketch; it sets the order only, so its errors cost time and no link.
SKETCH = 1 << 22
SKETCH_PARTS = 64
BLOCK_SHINGLES = 1_000_000

_U = np.uint64


class Shingler:
    """Distinct word shingles of a text as sorted 64-bit hashes."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.words: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        h = self.words.get(word)
        if h is None:
            if len(self.words) > 500_000:
                self.words.clear()
            h = self.words[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").translate(LOWER).split()
        if not words:
            return np.zeros(0, _U)
        if len(words) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], _U)
        h = np.fromiter(map(self._hash, words), _U, len(words))
        n = len(words) - self.width + 1
        out = np.zeros(n, _U)
        with np.errstate(over="ignore"):
            for i in range(self.width):
                out = (out ^ (out >> _U(31))) * _U(0x9E3779B97F4A7C15) + h[i:i + n]
            out = (out ^ (out >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        return np.unique(out ^ (out >> _U(32)))


def _least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Common shingles that a set of n needs with any partner."""
    return (percent * n + 99) // 100


def classes(docs: DataFrame, doc_id: str, text: str, width: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, rk, c, n) of each document, and the sketch of shingle counts."""
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    src = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("rk"), F.col(text).cast("binary").alias("text"))
    names = ["doc_id", "rk", "c", "n", "part", "counts"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sketch, id_type = Shingler(width), np.zeros(SKETCH, np.int32), None
        for batch in batches:
            id_type = batch.column(0).type
            cs, ns = [], []
            for body in next(columns(batch, "text")):
                s = shingles(body)
                cs.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                ns.append(len(s))
                sketch[(s & _U(SKETCH - 1)).astype(np.int64)] += 1
            m = len(ns)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(cs, _U).view(np.int64)), pa.array(ns, pa.int64()),
                                              pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        if id_type is not None:
            parts = np.split(sketch, SKETCH_PARTS)
            m = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, id_type), *[pa.nulls(m, pa.int64())] * 3, pa.array(range(m), pa.int32()),
                                              pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    both = written(src.mapInArrow(go, f"doc_id {kind}, rk long, c long, n long, part int, counts binary"), "jaccard-classes")

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH // SKETCH_PARTS, np.int64)
        for counts in table.column("counts").to_pylist():
            total += np.frombuffer(counts, np.int32)
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    sums = both.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(add, "part int, counts binary")
    sketch = np.zeros(SKETCH, np.int64)   # 32 MB, whatever the input
    for row in sums.collect():
        size = SKETCH // SKETCH_PARTS
        sketch[row["part"] * size:(row["part"] + 1) * size] = np.frombuffer(row["counts"], np.int64)
    return both.where("part is null").select("doc_id", "rk", "c", "n"), sketch


def index_rows(docs: DataFrame, text: str, width: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """(t, c, n): the index shingles of each class; copies inside a task are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts, seen = Shingler(width), shared.value, set()
        for batch in batches:
            ts, cs, ns = [], [], []
            for body in batch.column(0).to_pylist():
                s = shingles(body)
                if not len(s):
                    continue
                c = xxhash.xxh3_64_intdigest(s.tobytes())
                if c in seen:
                    continue
                seen.add(c)
                need = _least_overlap(len(s), percent)
                take = len(s) - need + min(COMMON, need)
                rare = counts[(s & _U(SKETCH - 1)).astype(np.int64)]
                order = np.lexsort((s, rare))[:take]
                ts.append(s[order])
                cs.append(np.full(take, c, _U))
                ns.append(np.full(take, len(s), np.int64))
            if ts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ts).view(np.int64)), pa.array(np.concatenate(cs).view(np.int64)),
                                                  pa.array(np.concatenate(ns))], names=["t", "c", "n"])

    return docs.select(F.col(text).cast("binary")).mapInArrow(go, "t long, c long, n long")


def index_lists(index: DataFrame, percent: int, short_list: int = SHORT_LIST) -> DataFrame:
    """(ac, an, bc, bn): a pair of fitting sizes from a short list; or, with bn null, class a in the long list of shingle bc."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, run, long_, last = None, [], False, None
        out: list[tuple] = []

        def pairs() -> None:
            for j in range(1, len(run)):
                for i in range(j):
                    (a, n), (b, m) = run[i], run[j]
                    if 100 * min(n, m) >= percent * max(n, m):
                        out.append((a, n, b, m))
        for batch in batches:
            t = batch.column(0).to_numpy(zero_copy_only=False)
            same = np.ones(len(t) + 1, bool)           # lists may go on in the next batch
            same[1:-1] = t[1:] == t[:-1]
            rows = np.flatnonzero(same[:-1] | same[1:])
            cols = [t[rows].tolist()] + [batch.column(i).to_numpy(zero_copy_only=False)[rows].tolist() for i in (1, 2)]
            for tok, c, n in zip(*cols):
                if tok != token:
                    if not long_:
                        pairs()
                    token, run, long_, last = tok, [], False, None
                if (c, n) == last:                     # a copy from another task
                    continue
                last = (c, n)
                if long_:
                    out.append((c, n, tok, None))
                    continue
                run.append(last)
                if len(run) > short_list:
                    out += [(*x, tok, None) for x in run]
                    long_, run = True, []
            if out:
                yield _rows(out)
                out.clear()
        if not long_:
            pairs()
        if out:
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["ac", "an", "bc", "bn"])

    return index.repartition("t").sortWithinPartitions("t", "c", "n").mapInArrow(go, "ac long, an long, bc long, bn long")


def _key(c: str, n: str) -> Column:
    return F.struct(F.col(c).alias("c"), F.col(n).alias("n"))


def pair_edges(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that share enough short lists."""
    need = F.least(F.lit(COMMON), *[F.floor((F.col(x) * percent + 99) / 100) for x in ("an", "bn")])
    return (lists.where("bn is not null").groupBy("ac", "an", "bc", "bn").agg(F.count(F.lit(1)).alias("w")).where(F.col("w") >= need)
            .select(_key("ac", "an").alias("a"), _key("bc", "bn").alias("b")))


class Links:
    """Links between the sets of two blocks (or inside one), with counts derived from the set before."""

    def __init__(self, keys: list[tuple[int, int]], sets: list[np.ndarray], many: list[int], sides: list[int], lists: list[list[int]],
                 here: int | None, percent: int) -> None:
        order = sorted(range(len(keys)), key=lambda i: (len(sets[i]), keys[i]))
        self.keys, self.sets = [keys[i] for i in order], [sets[i] for i in order]
        self.many = np.array([many[i] for i in order])
        self.side = np.array([sides[i] for i in order])
        self.sizes = np.array([len(s) for s in self.sets])
        self.percent = percent
        # long lists that come before this group: a pair that shares one is counted there
        earlier = [sorted(t for t in lists[i] or () if here is None or t < here) for i in order]
        number = {t: k for k, t in enumerate(sorted({t for x in earlier for t in x}))}
        self.elsewhere = np.zeros((len(self.sets), len(number)), bool)
        for i, x in enumerate(earlier):
            self.elsewhere[i, [number[t] for t in x]] = True
        tokens = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(self.sets)), self.sizes)
        by_token = np.argsort(tokens, kind="stable")   # owners of a list stay in the order of size
        self.owners = owner[by_token]
        self.lists, first = np.unique(tokens[by_token], return_index=True)
        self.ends = np.append(first, len(tokens))

    def _count(self, tokens: np.ndarray, low: int) -> np.ndarray:
        """For each set from position `low` on, how many of the tokens it has; lists are entered at that position."""
        at = np.searchsorted(self.lists, tokens)
        found = [self.owners[self.ends[i]:self.ends[i + 1]] for i in at.tolist()]
        if not found:
            return np.zeros(len(self.sets), np.int64)
        if low:
            found = [x[np.searchsorted(x, low):] if len(x) > 64 and x[0] < low else x for x in found]
        return np.bincount(np.concatenate(found), minlength=len(self.sets))

    def run(self, cross: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """(linked documents of each set, edges of a spanning forest)."""
        degree = np.zeros(len(self.sets), np.int64)
        parent = list(range(len(self.sets)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i
        edges, counts, before, entered = [], None, None, 0
        # partners of smaller size were met from their own side, so set i looks at later positions only
        for i, s in enumerate(self.sets):
            new = np.setdiff1d(s, before, assume_unique=True) if before is not None else s
            if before is not None and 2 * len(new) < len(s):
                gone = np.setdiff1d(before, s, assume_unique=True)
                counts = counts + self._count(new, entered) - self._count(gone, entered)
            else:
                entered = i
                counts = self._count(s, entered)
            before = s
            end = int(np.searchsorted(self.sizes, 100 * len(s) // self.percent, side="right"))
            c = counts[i + 1:end]
            union = len(s) + self.sizes[i + 1:end] - c
            hit = 100 * c >= self.percent * union
            if cross:
                hit &= self.side[i + 1:end] != self.side[i]
            partners = np.flatnonzero(hit) + i + 1
            if not len(partners):
                continue
            new_here = partners[~(self.elsewhere[partners] & self.elsewhere[i]).any(axis=1)]
            degree[i] += self.many[new_here].sum()
            degree[new_here] += self.many[i]
            for j in partners.tolist():
                a, b = root(i), root(j)
                if a != b:
                    parent[a] = b
                    edges.append((i, j))
        return degree, edges


def verified(docs: DataFrame, text_rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(ac, an, bc, bn, links): spanning edges (links null) and link counts (b null) of the classes in families."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        at, group = None, {}

        def decide() -> list[tuple]:
            keys = list(group)
            if len(keys) < 2:
                return []
            (root, i, j) = at
            here = root[0] if root[1] is None else None
            links = Links(keys, *([group[k][x] for k in keys] for x in range(4)), here, percent)
            degree, edges = links.run(cross=i != j)
            return ([(*links.keys[x], None, None, int(d)) for x, d in enumerate(degree.tolist()) if d]
                    + [(*links.keys[x], *links.keys[y], None) for x, y in edges])
        for batch in batches:
            out: list[tuple] = []
            for root, i, j, c, n, many, side, lists, body in zip(*columns(batch, "root", "i", "j", "c", "n", "many", "side", "lists", "text")):
                place = ((root["c"], root["n"]), i, j)
                if place != at:
                    out += decide()
                    at, group = place, {}
                if (c, n) not in group:
                    group[(c, n)] = (shingles(body), many, side, lists)
            if out:
                yield _rows(out)
        out = decide()
        if out:
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["ac", "an", "bc", "bn", "links"])

    return text_rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(
        go, "ac long, an long, bc long, bn long, links long")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """One document of each component, and all without words: the smallest (id, row key), null ids last.

    Of rows equal in id and text one stays; where their other columns differ, any one of them."""
    linked = written(link_components(docs, doc_id, text, width, percent).select("doc_id", "n_shingles", "rk", "group"), "jaccard-groups")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")
    worded = linked.where("n_shingles > 0")
    first = worded.groupBy("group").agg(F.min(place).alias("w")).select(F.col("w.rk").alias("rk"))
    again = worded.groupBy("rk").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rk")
    alone = first.join(again, "rk", "left_anti").unionByName(linked.where("n_shingles = 0").select("rk").distinct())
    # the documents travel in one column, so that no name clashes; only repeated rows are put side by side
    keyed = docs.select(F.struct(*each(docs.columns)).alias("doc"), row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("rk"))
    out = keyed.join(alone, "rk", "left_semi").unionByName(
        keyed.join(first.join(again, "rk", "left_semi"), "rk", "left_semi").dropDuplicates(["rk"]))
    return out.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def link_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85,
                    short_list: int = SHORT_LIST, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, rk, group (the same for the documents of a component): one row a document."""
    rows, sketch = classes(docs, doc_id, text, width)
    lists = written(index_lists(index_rows(docs, text, width, percent, sketch), percent, short_list), "jaccard-lists")
    short = components(starred(pair_edges(lists, percent))).select(F.col("node").alias("k"), "root")
    long_ = lists.where("bn is null").select(_key("ac", "an").alias("k"), F.struct(F.col("bc").alias("c"), F.lit(None).cast("long").alias("n")).alias("root"))
    held = long_.groupBy("k").agg(F.collect_list("root.c").alias("lists"))
    keyed = rows.select("doc_id", "rk", F.struct("c", "n").alias("k"))
    sized = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("many"), F.min("doc_id").alias("low"), F.min("rk").alias("rk"))
    members = written(sized.join(short.unionByName(long_), "k").join(held, "k", "left"), "jaccard-members")
    n_blocks = members.groupBy("root").agg(F.ceil(F.sum("k.n") / F.lit(block_shingles)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("k.c", "k.n"), F.col("blocks")).cast("int")
    n_blocks = n_blocks.select(F.col("root").alias("of"), "blocks")
    dealt = members.join(n_blocks, F.col("root").eqNullSafe(F.col("of"))).withColumn("side", block)
    # every pair of blocks, the block with itself included: the smaller number first
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = (dealt.withColumn("o", other).select("root", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side",
                                                  F.col("k.c").alias("c"), F.col("k.n").alias("n"), "many", "lists", "rk"))
    texts = docs.select(row_key(F.col(doc_id), F.col(text)).alias("rk"), F.col(text).cast("binary").alias("text"))
    decided = written(verified(docs, texts.join(placed, "rk"), width, percent), "jaccard-links")
    a, b = F.struct(F.col("ac").alias("c"), F.col("an").alias("n")), F.struct(F.col("bc").alias("c"), F.col("bn").alias("n"))
    linked = components(decided.where("links is null").select(a.alias("a"), b.alias("b"))).withColumnRenamed("node", "k")
    degree = decided.where("links is not null").groupBy(a.alias("k")).agg(F.sum("links").alias("links"))
    lows = linked.join(members.select("k", "low").distinct(), "k").groupBy("root").agg(F.min("low").alias("least"))
    answer = (sized.join(linked, "k", "left").join(lows, "root", "left").join(degree, "k", "left")
              .select("k", F.coalesce("root", "k").alias("group"), F.coalesce("least", "low").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links")))
    empty = F.col("k.n") == 0
    return keyed.join(answer, "k").select(
        "doc_id", F.col("k.n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), "rk", "group")
