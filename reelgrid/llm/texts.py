"""What the operators share: words of texts, row keys, and tables written to the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: bytes.split() without an argument splits at exactly [\x20\x09-\x0D].
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
WORD_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).translate(LOWER)
#: Bytes that do not begin a code point.
CONTINUATION = bytes(range(0x80, 0xC0))
BLANKS = b" \t\n\x0b\x0c\r"


def n_points(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(data.translate(None, CONTINUATION))


def digests(items: list[bytes]) -> bytes:
    """128-bit digests, 16 bytes each."""
    hashed = xxhash.xxh3_128_digest
    return b"".join([hashed(x) for x in items])


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """The same rows, read again from a table in the shared folder: later reads need no lineage."""
    spark = df.sparkSession
    path = os.path.join(folder(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def each(columns_: list[str]) -> list[Column]:
    """The named columns, dots and all."""
    return [F.col(f"`{c}`") for c in columns_]


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows of one doc_id apart; equal rows share it, and then share every decision."""
    return F.xxhash64(doc_id.isNull(), doc_id, text.isNull(), text)


def columns(batch: pa.RecordBatch, *names: str) -> Iterator[list]:
    """Python lists of the named columns."""
    return (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)
