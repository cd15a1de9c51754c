"""Token counts through a digest cache.

A text is named by the digest of its normalised content and of the tokenizer (its file and the settings). Counts are kept in a
Parquet table by that name; a run joins its digests to the table, encodes each distinct missing text once and
appends the new counts. Copies inside a task are dropped before their text is moved, so that a hot text moves at
most once for each task.

Nulls: a null text is the empty one, with 0 tokens. Ids are passed through, so null or repeated ids are kept. Rows with equal
texts share one count. An empty table gives no rows and appends nothing. Two runs may append the same digest: it has
the same count, and reading takes one.
Long texts are encoded whole. Other columns are not read, so their names do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame, functions as F

from reelgrid.llm.texts import columns

#: What counts are made of besides the file: no begin, end or added special tokens, no truncation or padding.
SETTINGS = "plain-1"
CACHE = "digest string, version string, n_tokens long"


@lru_cache(maxsize=4)
def encoder(path: str):
    """Texts -> token counts, for a .json or .model file."""
    if path.endswith(".json"):
        tok = tokenizers.Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(sp.encode(x)) for x in texts]


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the settings."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + SETTINGS.encode()).hexdigest()[:32]


def read_cache(docs: DataFrame, path: str, version: str) -> DataFrame:
    """digest, n_tokens of one tokenizer; empty where no table was written yet."""
    spark = docs.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "digest string, n_tokens long")
    return (spark.read.schema(CACHE).parquet(path).where(F.col("version") == version)
            .groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")))


def _first_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops texts that the task has passed on before; it holds 16 bytes for each distinct text."""
    seen: set[bytes] = set()
    for batch in batches:
        take = []
        for i, name in enumerate(next(columns(batch, "digest"))):
            short = bytes.fromhex(name[:32])
            if short not in seen:
                seen.add(short)
                take.append(i)
        yield batch.take(pa.array(take, pa.int32()))


def encode_missing(texts: DataFrame, known: DataFrame, path: str) -> DataFrame:
    """digest, n_tokens of the distinct texts (digest, text) that are not known."""
    missing = texts.mapInArrow(_first_in_task, "digest string, text string").join(known, "digest", "left_anti")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last = encoder(path), None
        for batch in batches:
            names, bodies = columns(batch, "digest", "text")
            fresh = []
            for i, name in enumerate(names):         # sorted: copies stand together
                if name != last:
                    fresh.append(i)
                    last = name
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in fresh], pa.string()),
                                              pa.array(count([bodies[i] for i in fresh]), pa.int64())], names=["digest", "n_tokens"])

    return missing.repartition("digest").sortWithinPartitions("digest").mapInArrow(go, "digest string, n_tokens long")


def token_counts(docs: DataFrame, cache_path: str, tokenizer: str = "piece_bpe_32k.model", doc_id: str = "doc_id",
                 text: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. Appends to the cache while it is built, then only reads it."""
    path = public_tokenizers.path(tokenizer)
    version = tokenizer_version(path)
    body = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.sha2(body.cast("binary"), 256).alias("digest"))
    made = encode_missing(named.select("digest", "text"), read_cache(docs, cache_path, version), path)
    made.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache_path)
    counts = read_cache(docs, cache_path, version)
    slim = named.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return (slim.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
