"""URL filters: exact membership in a list of keys through a cascade of Bloom filters.

The key universe is every key that the corpus can ask for: for each url, the host and its parent domains, each with every
path prefix of a length that occurs in the list. Level 1 encodes the listed keys; the keys of the universe that it
wrongly passes are encoded in level 2, the listed keys that level 2 wrongly passes in level 3, and so on until no wrong key is
left. Over its universe the cascade answers exactly, so urls are judged row by row, with no join and no shuffle.

Filters are built by Spark (one row for each 64-bit word with a bit) and broadcast. A cascade takes at most KEYS_PER_FILTER
listed keys; longer lists are split by key hash, and the urls pass over one cascade after the other.

Nulls: a null url, or one without `://`, has an empty host and path, fits no key and is allowed. Urls are judged row by row, so repeated
rows, ties and null ids need no care. An empty list allows all; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from reelgrid.llm.texts import columns, written

#: Listed keys of one cascade: at 10 bits a key its first level stays under 6 MB, and later levels are smaller.
KEYS_PER_FILTER = 4_000_000
BITS_PER_KEY = 10
HASHES = 4
#: The rules of the registered query (key, verdict), as host and path prefix.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Words whose hosts the registered query lists as blocked where no rule fits.
BLOCKED_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")

_U = np.uint64


def parts_of(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path)."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return host, path[:stop]


def domains(host: str) -> list[str]:
    """The host and its parent domains, longest first."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] if host else []


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Keys that could fit, longest first; of equal length, the longer host first."""
    keys = [d + path[:n] for d in domains(host) for n in lengths if n <= len(path)]
    return sorted(keys, key=len, reverse=True)


def hashes(keys: list[str]) -> np.ndarray:
    """128 bits a key, as two columns."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(k.encode()) for k in keys), "<u8").reshape(-1, 2)


def _mixed(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of a level, independent of those of other levels."""
    with np.errstate(over="ignore"):
        def mix(x: np.ndarray, add: int) -> np.ndarray:
            x = x + _U(add * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
            return x ^ (x >> _U(31))
        return mix(h[:, 0] ^ (h[:, 1] << _U(1)), 2 * level + 1), mix(h[:, 1], 2 * level + 2) | _U(1)


def _pairs(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).view(_U) for n in ("h1", "h2")])


def positions(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bit positions: one row a key."""
    a, b = _mixed(h, level)
    with np.errstate(over="ignore"):
        return (a[:, None] + np.arange(HASHES, dtype=_U) * b[:, None]) % _U(bits)


@dataclass
class Cascade:
    """Levels of (bits, 64-bit words)."""

    levels: list[tuple[int, np.ndarray]]

    def passes(self, h: np.ndarray, level: int) -> np.ndarray:
        bits, words = self.levels[level]
        at = positions(h, level, bits)
        return ((words[at >> _U(6)] >> (at & _U(63))) & _U(1)).all(axis=1)

    def member(self, h: np.ndarray) -> np.ndarray:
        """Listed or not, exact for keys of the universe."""
        out = np.full(len(h), len(self.levels) % 2 == 1)
        open_ = np.ones(len(h), bool)
        for level in range(len(self.levels)):
            stopped = open_ & ~self.passes(h, level) if len(h) else open_
            out[stopped] = level % 2 == 1
            open_ &= ~stopped
        return out


def _filter(keys: DataFrame, level: int) -> tuple[int, np.ndarray] | None:
    """The Bloom filter of (h1, h2) rows; None for no rows."""
    n = keys.count()
    if not n:
        return None
    bits = max(64, n * BITS_PER_KEY)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _pairs(batch)
            at = positions(h, level, bits).ravel()
            word = (at >> _U(6)).astype(np.int64)
            mask = (_U(1) << (at & _U(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask)], names=["word", "mask"])

    rows = keys.select("h1", "h2").mapInArrow(go, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros((bits + 63) // 64, _U)
    words[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(_U)
    return bits, words


def build(universe: DataFrame) -> Cascade:
    """The cascade over the distinct keys (h1, h2, listed boolean)."""
    inside, outside = universe.where("listed"), universe.where("not listed")
    levels: list[tuple[int, np.ndarray]] = []
    while (made := _filter(inside, len(levels))) is not None:
        if len(levels) > 60:
            raise RuntimeError("two keys of the universe have equal hashes")
        levels.append(made)
        held = Cascade([(64, np.zeros(1, _U))] * (len(levels) - 1) + [made])
        level = len(levels) - 1

        def go(batches: Iterator[pa.RecordBatch], held=held, level=level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = _pairs(batch)
                yield batch.filter(pa.array(held.passes(h, level)))

        wrong = written(outside.mapInArrow(go, outside.schema), "cascade-level")
        inside, outside = wrong, inside
    return Cascade(levels)


def universe_of(urls: DataFrame, listed: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, h1, h2, listed): all keys the urls can ask for, and all listed keys, each once. `urls` has `url`, `listed` has `key`."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {k for u in batch.column(0).to_pylist() for k in candidates(*parts_of(u), lengths)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["key"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = hashes(batch.column(0).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(1)], names=["key", "h1", "h2", "listed"])

    asked = urls.select("url").mapInArrow(keys, "key string").withColumn("listed", F.lit(False))
    both = asked.unionByName(listed.select("key", F.lit(True).alias("listed")))
    return both.groupBy("key").agg(F.max("listed").alias("listed")).mapInArrow(hashed, "key string, h1 long, h2 long, listed boolean")


def cascades(universe: DataFrame, n_listed: int) -> Iterator[Cascade]:
    """One cascade for each share of the listed keys, all over the whole universe."""
    shares = max(1, math.ceil(n_listed / KEYS_PER_FILTER))
    for s in range(shares):
        yield build(universe.withColumn("listed", F.col("listed") & (F.pmod("h1", F.lit(shares)) == s)))


def listed_hosts(urls: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """(key) of the corpus's hosts that have one of the words in a label."""
    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {parts_of(u)[0] for u in batch.column(0).to_pylist()}
            bad = sorted(h for h in found if any(w in part.split("-") for part in h.split(".") for w in words))
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], names=["key"])

    return urls.select("url").mapInArrow(hosts, "key string").distinct()


def judge_urls(pages: DataFrame, rules: DataFrame, blocked: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict.

    `rules` has host, path and verdict: the longest fitting one decides. Other urls are blocked where the host or a
    parent domain is a key of `blocked`, else allowed.
    """
    spark: SparkSession = pages.sparkSession
    urls = pages.select(F.col(url).alias("url"))
    lengths = sorted(r["n"] for r in rules.select(F.length("path").alias("n")).distinct().collect())
    all_rules = rules.select(F.concat("host", "path").alias("key"), F.col("verdict"))
    tests = [("rule", all_rules.select("key").distinct(), lengths),
             ("refused", all_rules.where("verdict = 'block'").select("key").distinct(), lengths),
             ("host", blocked.select("key").distinct(), [0])]
    df = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("__url"), *[F.array().cast("array<string>").alias(f"__{t[0]}") for t in tests])
    schema = df.schema
    first = True
    for name, listed, sizes in tests:
        universe = written(universe_of(urls, listed, sizes), "url-keys")
        n = universe.where("listed").count()
        for cascade in cascades(universe, n):
            if not cascade.levels:
                continue
            held = spark.sparkContext.broadcast(cascade)

            def go(batches: Iterator[pa.RecordBatch], held=held, name=name, sizes=sizes) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    asked = [candidates(*parts_of(u), sizes) for u in next(columns(batch, "__url"))]
                    flat = sorted({k for keys in asked for k in keys})
                    hit = {k for k, yes in zip(flat, held.value.member(hashes(flat)).tolist()) if yes}
                    at = batch.schema.get_field_index(f"__{name}")
                    had = batch.column(at).to_pylist()
                    cols = [batch.column(i) for i in range(batch.num_columns)]
                    cols[at] = pa.array([h + [k for k in keys if k in hit] for h, keys in zip(had, asked)], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

            if n > KEYS_PER_FILTER and not first:
                df = written(df, "url-marks")            # one cascade at a time in a worker's memory
            df, first = df.mapInArrow(go, schema), False

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for u, rule, refused, host in zip(*columns(batch, "__url", "__rule", "__refused", "__host")):
                longest = max(rule, key=len, default=None)
                block = longest in refused if longest is not None else bool(host)
                rows.append((*parts_of(u), longest, "block" if block else "allow"))
            made = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, pa.string()) for c in made], names=["page_id", "host", "path", "rule", "verdict"])

    kind = schema["page_id"].dataType.simpleString()
    return df.mapInArrow(verdicts, f"page_id {kind}, host string, path string, rule string, verdict string")


SQL = r"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, lower(regexp_extract(rest, '^[^/?#]*')) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(rh, rp, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m as (select h.page_id, h.host, h.path, r.rh || r.rp as rule, r.v,
        row_number() over (partition by h.page_id order by length(r.rh || r.rp) desc nulls last) as k
      from h left join r on (h.host = r.rh or ends_with(h.host, '.' || r.rh)) and starts_with(h.path, r.rp))
select page_id, host, path, rule, coalesce(v, case when regexp_matches(host, '(^|[.-])(adult|ads|bets|casino|pills|spam)([.-]|$)') then 'block' else 'allow' end) as verdict
from m where k = 1
"""
