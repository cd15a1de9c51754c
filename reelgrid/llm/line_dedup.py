"""Line dedup: lines found in several documents stay only in the last document that holds them.

Every long line is one row (128-bit digest of its key, document, positions), and the rows are range-partitioned by
digest, then document, so that a line held by very many documents spreads over several partitions. Sorted
partitions are streamed: the first row of a digest holds the document that keeps the line, later rows drop it once
enough documents are seen. What a partition must know of its neighbours (a digest that goes on across the edge) is
one summary row for each partition. The result is one compressed keep bitmap for each document that loses a line;
texts are not moved until the bitmaps are applied.

Nulls: a null or empty text is one empty line, which is never dropped; a null id counts as one document, the smallest.
Rows of the same id are one document, and equal rows get equal bitmaps. Ties cannot arise: a document either
is the largest id of a line or is not. An empty table gives empty results.
Long texts are taken whole. Other columns are not read; carried ones travel in a struct, so their names do not matter. Ids are
whole numbers.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from reelgrid.llm.texts import BLANKS, LOWER, columns, digests, each, n_points, row_key
from reelgrid.session import checkpointed

_LOWEST = -(1 << 63)


def line_keys(text: bytes, min_chars: int) -> dict[bytes, list[int]]:
    """{key: positions} of the lines whose key is long enough."""
    found: dict[bytes, list[int]] = {}
    for at, line in enumerate(text.split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(BLANKS).translate(LOWER)
            if len(key) >= min_chars and n_points(key) >= min_chars:
                found.setdefault(key, []).append(at)
    return found


def line_rows(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """One row for each document and distinct long line: h1, h2, doc (null as the lowest), rk, n_lines, at (positions)."""
    src = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LOWEST)).alias("doc"), row_key(F.col(doc_id), F.col(text)).alias("rk"),
                      F.col(text).cast("binary").alias("text"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs_, rks, sizes, ats = [], [], [], [], []
            for doc, rk, body in zip(*columns(batch, "doc", "rk", "text")):
                body = body or b""
                found = line_keys(body, min_chars)
                keys += found
                docs_ += [doc] * len(found)
                rks += [rk] * len(found)
                sizes += [body.count(b"\n") + 1] * len(found)
                ats += [np.array(x, "<i4").tobytes() for x in found.values()]
            h = np.frombuffer(digests(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(docs_, pa.int64()), pa.array(rks, pa.int64()),
                 pa.array(sizes, pa.int32()), pa.array(ats, pa.binary())], names=["h1", "h2", "doc", "rk", "n_lines", "at"])

    return src.mapInArrow(go, "h1 long, h2 long, doc long, rk long, n_lines int, at binary")


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the partition's first and last digest, with the documents seen of each and their first and last id."""
    first = last = None
    for batch in batches:
        for h1, h2, doc in zip(*columns(batch, "h1", "h2", "doc")):
            if last is None or last[0] != (h1, h2):
                last = [(h1, h2), 1, doc, doc]
                first = first or last
            elif last[3] != doc:
                last[1], last[3] = last[1] + 1, doc
    if first is None:
        return
    row = [TaskContext.get().partitionId(), *first[0], *first[1:], *last[0], *last[1:], first is last]
    names = ["pid", "f1", "f2", "fn", "ftop", "fend", "l1", "l2", "ln", "ltop", "lend", "whole"]
    yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(names, row)})


def _carry(rows: list) -> dict[int, tuple]:
    """{partition: (documents before of its first digest, top document of it, last one before, documents after of its last digest)}."""
    rows = sorted(rows, key=lambda r: r["pid"])
    before: dict[int, tuple] = {}
    run = None                                       # the last digest so far: digest, documents, top and last document
    for r in rows:
        same = run is not None and run[0] == (r["f1"], r["f2"])
        before[r["pid"]] = (run[1], run[2], run[3]) if same else (0, None, None)
        if same and r["whole"]:
            run = (run[0], run[1] + r["fn"] - (run[3] == r["ftop"]), run[2], r["fend"])
        else:
            run = ((r["l1"], r["l2"]), r["ln"], r["ltop"], r["lend"])
    after: dict[int, int] = {}
    run = None                                       # the first digest of what follows: digest, documents, top document
    for r in reversed(rows):
        same = run is not None and run[0] == (r["l1"], r["l2"])
        after[r["pid"]] = run[1] - (run[2] == r["lend"]) if same else 0
        if same and r["whole"]:
            run = (run[0], run[1] + r["fn"] - (run[2] == r["fend"]), r["ftop"])
        else:
            run = ((r["f1"], r["f2"]), r["fn"], r["ftop"])
    return {p: (*before[p], after[p], (r["l1"], r["l2"])) for p, r in ((r["pid"], r) for r in rows)}


def dropped_rows(rows: DataFrame, min_docs: int) -> DataFrame:
    """(doc, rk, n_lines, at) of the lines to drop."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["h1", "h2", F.col("doc").desc()]
    # the ranges are fixed by the checkpoint: the edges and the decisions see the same partitions
    placed = checkpointed(rows.repartitionByRange(n, *order).sortWithinPartitions(*order))
    edges = placed.mapInArrow(_edges, "pid long, f1 long, f2 long, fn long, ftop long, fend long, l1 long, l2 long, ln long, ltop long, "
                                      "lend long, whole boolean").collect()
    carry = _carry(edges)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, top0, end0, after, last_key = carry.get(TaskContext.get().partitionId(), (0, None, None, 0, None))
        key = None
        docs = later = 0
        top = end = None
        waiting: list[tuple] = []                    # rows of the documents that were too few so far
        fresh = True
        for batch in batches:
            out = []
            for h1, h2, doc, rk, size, at in zip(*columns(batch, "h1", "h2", "doc", "rk", "n_lines", "at")):
                if (h1, h2) != key:
                    key, waiting = (h1, h2), []
                    docs, top, end = (before, top0, end0) if fresh else (0, None, None)
                    later = after if key == last_key else 0
                    fresh = False
                if docs == 0:
                    top = doc
                if docs == 0 or doc != end:
                    docs, end = docs + 1, doc
                if doc != top:
                    waiting.append((doc, rk, size, at))
                if docs + later >= min_docs and waiting:
                    out += waiting
                    waiting = []
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                                             names=["doc", "rk", "n_lines", "at"])

    return placed.mapInArrow(go, "doc long, rk long, n_lines int, at binary")


@F.pandas_udf(T.BinaryType())
def _bitmap(n_lines: pd.Series, ats: pd.Series) -> pd.Series:
    def one(n: int, parts: list[bytes]) -> bytes:
        keep = np.ones(n, bool)
        keep[np.frombuffer(b"".join(parts), "<i4")] = False
        return zlib.compress(np.packbits(keep).tobytes())
    return pd.Series([one(n, parts) for n, parts in zip(n_lines, ats)], index=n_lines.index, dtype=object)


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """(doc, rk, keep): zlib of one bit a line, only for the rows that lose a line."""
    lost = dropped_rows(line_rows(docs, doc_id, text, min_chars), min_docs)
    # equal rows of a table bring the same positions twice, which changes no bit
    return lost.groupBy("doc", "rk").agg(_first("n_lines"), F.collect_list("at").alias("ats")).select(
        "doc", "rk", _bitmap("n_lines", "ats").alias("keep"))


def _first(name: str) -> Column:
    return F.max(name).alias(name)


def kept_lines(text: bytes, keep: bytes | None) -> tuple[bytes, int, int]:
    """(text of the lines that stay, lines, dropped lines)."""
    lines = text.split(b"\n")
    if keep is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    stay = [x for x, k in zip(lines, bits.tolist()) if k]
    return b"\n".join(stay), len(lines), len(lines) - len(stay)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 3, min_chars: int = 20,
                carry: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_lines, n_dropped, kept_sha256, and on demand kept_text and the carried columns (struct `doc`)."""
    maps = keep_bitmaps(docs, doc_id, text, min_docs, min_chars).select(
        F.col("doc").alias("__doc"), F.col("rk").alias("__rk"), F.col("keep").alias("__keep"))
    head = [F.col(doc_id).alias("doc_id")] + ([F.struct(*each(carry)).alias("doc")] if carry is not None else [])
    src = docs.select(*head, F.coalesce(F.col(doc_id).cast("long"), F.lit(_LOWEST)).alias("__doc"),
                      row_key(F.col(doc_id), F.col(text)).alias("__rk"), F.col(text).cast("binary").alias("__text"))
    met = src.join(maps, ["__doc", "__rk"], "left").drop("__doc", "__rk")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, keep in zip(*columns(batch, "__text", "__keep")):
                stay, n, gone = kept_lines(body or b"", keep)
                rows.append((n, gone, hashlib.sha256(stay).hexdigest(), stay if with_text else None))
            made = list(zip(*rows)) if rows else [()] * 4
            held = [i for i, f in enumerate(batch.schema) if f.name not in ("__text", "__keep")]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in held] + [pa.array(v, t) for v, t in zip(made, kinds)],
                names=[batch.schema.field(i).name for i in held] + ["n_lines", "n_dropped", "kept_sha256", "kept_text"])

    held = [f for f in met.schema if not f.name.startswith("__")]
    out = met.mapInArrow(go, T.StructType(held + T.StructType.fromDDL("n_lines long, n_dropped long, kept_sha256 string, kept_text binary").fields))
    return out.withColumn("kept_text", F.col("kept_text").cast("string")) if with_text else out.drop("kept_text")
