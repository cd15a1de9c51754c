"""Quality rules: how far a document's histograms are from those of its language.

Two histograms are taken of each text: character classes, and common words of its language with one
more bin for all other words. The references are built from all documents of a language. A document
is rejected when a Jensen-Shannon distance to its reference is too large; texts below a minimum
length are not judged by the histogram they are too short for.

Nulls: a null text has no words; a null language is a language of its own; a null id is kept as it
is. Rows are judged one by one, so repeated rows get equal results. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from reelgrid.llm.texts import CONTINUATION, columns, each, n_points, written

CLASSES = ("lower", "upper", "digit", "blank", "newline", "mark", "symbol", "beyond_ascii", "control")
SYMBOLS = b"#*$%&|<>"


def _class_of(c: int) -> int:
    if 0x80 <= c:
        return 8 if c < 0xC0 else 7                # bytes inside a code point are taken out below
    ch = chr(c)
    if ch.islower():
        return 0
    if ch.isupper():
        return 1
    if ch.isdigit():
        return 2
    if ch in " \t":
        return 3
    if ch in "\r\n":
        return 4
    if ch in ".,;:!?'\"()-":
        return 5
    return 6 if ch.isprintable() else 8


_CLASS = np.array([_class_of(c) for c in range(256)], dtype=np.uint8)


@dataclass(frozen=True)
class Limits:
    """Distances (0 to 1) above which a document is rejected, and the lengths from which they are judged."""

    class_distance: float = 0.32
    word_distance: float = 0.55
    min_chars: int = 200
    min_words: int = 50
    #: Share of a language's words from which a word is common: at most 1 / share words a language.
    common_share: float = 0.001


def class_counts(text: bytes) -> np.ndarray:
    """Code points of each character class."""
    starts = text.translate(None, CONTINUATION)
    return np.bincount(_CLASS[np.frombuffer(starts, np.uint8)], minlength=len(CLASSES))[:len(CLASSES)]


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits: 0 for equal, 1 for disjoint."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def kl(a: np.ndarray) -> float:
        use = a > 0
        return float((a[use] * np.log2(a[use] / m[use])).sum())
    return float(np.sqrt(max(0.0, (kl(p) + kl(q)) / 2)))


def repeat_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that is found twice or more in the text."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered = np.zeros(len(words), bool)
    many = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
    for shift in range(3):
        covered[shift:shift + len(windows)] |= many
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def language_references(docs: DataFrame, text: str, lang: str, limits: Limits) -> dict:
    """{language: (class histogram, {common word: bin}, word histogram)}.

    Counts are added up inside each task, then by Spark. What reaches the driver is one row for each
    language and at most 1 / common_share words of each.
    """
    schema = "lang string, word binary, n long, classes array<double>"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str | None, Counter] = {}
            classes: dict[str | None, np.ndarray] = {}
            for body, tongue in zip(*columns(batch, "text", "lang")):
                body = body or b""
                words.setdefault(tongue, Counter()).update(body.split())
                n = class_counts(body)
                classes[tongue] = classes.get(tongue, 0) + n / max(n.sum(), 1)
            for tongue, counts in words.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tongue] * len(counts), pa.string()), pa.array(counts.keys(), pa.binary()),
                     pa.array(counts.values(), pa.int64()), pa.nulls(len(counts), pa.list_(pa.float64()))],
                    names=["lang", "word", "n", "classes"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes.keys(), pa.string()), pa.nulls(len(classes), pa.binary()),
                 pa.array([sum(words[x].values()) for x in classes], pa.int64()),
                 pa.array([x.tolist() for x in classes.values()], pa.list_(pa.float64()))],
                names=["lang", "word", "n", "classes"])

    parts = docs.select(F.col(text).cast("binary").alias("text"), F.col(lang).alias("lang")).mapInArrow(go, schema)
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))]
    counted = written(parts.groupBy("lang", "word").agg(F.sum("n").alias("n"), *sums), "language-words")
    totals = F.broadcast(counted.where("word is null").select("lang", F.col("n").alias("total")))   # one row a language
    common = (counted.alias("c").join(totals.alias("t"), F.col("c.lang").eqNullSafe(F.col("t.lang")))
              .where((F.col("n") >= F.lit(limits.common_share) * F.col("total")) | F.col("word").isNull())
              .select("c.lang", "word", "n", "total", *[f"c{i}" for i in range(len(CLASSES))]))
    out: dict = {}
    for row in common.collect():
        entry = out.setdefault(row["lang"], [None, {}, row["total"]])
        if row["word"] is None:
            entry[0] = np.array([row[f"c{i}"] or 0.0 for i in range(len(CLASSES))])
        else:
            entry[1][bytes(row["word"])] = row["n"]
    made = {}
    for tongue, (hist, counts, total) in out.items():
        order = sorted(counts)
        share = np.array([counts[w] for w in order] + [total - sum(counts.values())], float)
        made[tongue] = (hist, {w: i for i, w in enumerate(order)}, share)
    return made


def distances(text: bytes, words: list[bytes], reference: tuple | None, limits: Limits) -> tuple[float | None, float | None]:
    """Distances of the character classes and of the common words; None where a text is too short to judge."""
    if reference is None:
        return None, None
    hist, bins, share = reference
    by_class = by_word = None
    if hist is not None and hist.any() and n_points(text) >= limits.min_chars:
        by_class = js_distance(class_counts(text).astype(float), hist)
    if len(words) >= limits.min_words and share.sum() > 0:
        mine = np.zeros(len(share))
        other = len(share) - 1
        for word, n in Counter(words).items():
            mine[bins.get(word, other)] += n
        by_word = js_distance(mine, share)
    return by_class, by_word


RESULT = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
          "n_repeat_words": pa.int64(), "class_distance": pa.float64(), "word_distance": pa.float64(),
          "base_failed": pa.bool_(), "kept": pa.bool_()}
_DDL = ", ".join(f"{k} {'boolean' if v == pa.bool_() else 'double' if v == pa.float64() else 'long'}" for k, v in RESULT.items())


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          limits: Limits = Limits(), carry: list[str] | None = None) -> DataFrame:
    """One row a document: its id, the counts, the two distances, base_failed and kept.

    `carry` names more columns of `docs` to return, under a struct `doc`, so that no name clashes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(language_references(docs, text, lang, limits))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = []
            for body, tongue in zip(*columns(batch, "__text", "__lang")):
                body = body or b""
                words = body.split()
                n, repeated = len(words), repeat_words(words)
                failed = n < 50 or 100 * repeated > 50 * n
                by_class, by_word = distances(body, words, known.get(tongue), limits)
                kept = not failed and (by_class or 0.0) <= limits.class_distance and (by_word or 0.0) <= limits.word_distance
                symbols = len(body) - len(body.translate(None, SYMBOLS))
                rows.append((n, n_points(b"".join(words)), symbols, duplicate_lines(body), repeated,
                             by_class, by_word, failed, kept))
            made = list(zip(*rows)) if rows else [()] * len(RESULT)
            held = [i for i, f in enumerate(batch.schema) if f.name not in ("__text", "__lang")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in held] + [pa.array(v, t) for v, t in zip(made, RESULT.values())],
                names=[batch.schema.field(i).name for i in held] + list(RESULT))

    head: list[Column] = [F.col(doc_id).alias("doc_id")]
    if carry is not None:
        head.append(F.struct(*each(carry)).alias("doc"))
    src = docs.select(*head, F.col(text).cast("binary").alias("__text"), F.col(lang).alias("__lang"))
    held = [f for f in src.schema if not f.name.startswith("__")]
    return src.mapInArrow(go, T.StructType(held + T.StructType.fromDDL(_DDL).fields))
