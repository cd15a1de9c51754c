"""Table reads, JSON documents, used clip ranges, file listings and writers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A text table, spread over the cores when its files give fewer tasks than there are cores
    (one small file is one task, and the work per text is high)."""
    df = read_table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_evolved(spark: SparkSession, path: str) -> DataFrame:
    """A table whose later files have more columns; missing values are NULL."""
    return spark.read.option("mergeSchema", "true").parquet(path)


ANALYSIS_SCHEMAS = {
    "transcript": "language string, text string, duration double, "
                  "segments array<struct<start:double,end:double,text:string>>, "
                  "words array<struct<start:double,end:double,word:string>>",
    "scenes": "cut_points array<double>, scenes array<struct<start:double,end:double>>",
    "audio": "rms_envelope struct<hop_sec:double,values:array<double>>, "
             "peaks array<struct<t:double,energy:double>>, silences array<struct<start:double,end:double>>",
    "faces": "samples array<struct<t:double,cx:double,cy:double,found:boolean>>",
    "diarization": "turns array<struct<start:double,end:double,speaker:string>>",
    "vision_digest": "frames array<struct<t:double,desc:string,act:double>>",
}
# The array of each document kind that becomes rows.
ANALYSIS_ROWS = {"transcript": "segments", "scenes": "cut_points", "audio": "peaks",
                 "faces": "samples", "diarization": "turns", "vision_digest": "frames"}


def explode_analysis(analysis: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of the finished documents of one kind; rejects hold unreadable JSON."""
    done = analysis.filter((F.col("kind") == kind) & (F.col("status") == "done"))
    parsed = done.withColumn("doc", F.from_json("data", ANALYSIS_SCHEMAS[kind]))
    items = F.col(f"doc.{ANALYSIS_ROWS[kind]}")
    rows = (parsed.filter(items.isNotNull())
            .select("video_id", F.posexplode(items).alias("idx", "item")))
    return rows, parsed.filter(items.isNull()).select("video_id", "kind", "data")


def used_segments(clips: DataFrame) -> DataFrame:
    """One row per range a clip uses: recap windows, else segments, else moments, else its span."""
    def ranges(c: str) -> Column:
        good = F.filter(F.col(c), lambda r: r.e > r.s)
        return F.when(F.size(good) > 0, good)
    whole = F.array(F.struct(F.col("start_ms").alias("s"), F.col("end_ms").alias("e")))
    picked = F.coalesce(ranges("windows"), ranges("segments"), ranges("moments"),
                        F.filter(whole, lambda r: r.e > r.s))
    return (clips.select("clip_id", "video_id", "status", F.posexplode(picked).alias("seg_idx", "r"))
            .select("clip_id", "video_id", "status", "seg_idx",
                    F.col("r.s").alias("s_ms"), F.col("r.e").alias("e_ms")))


# Extensions taken as video files.
VIDEO_EXTENSIONS = ["mp4", "mkv", "mov", "avi", "webm", "m4v"]


def list_media_files(spark: SparkSession, root: str) -> DataFrame:
    """Listing of the video files below `root`/channel; the file content is never read."""
    ext = ",".join(f"{e},{e.upper()}" for e in VIDEO_EXTENSIONS)
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.{" + ext + "}").load(root)
            .select(F.element_at(F.split("path", "/"), -2).alias("channel"), "path",
                    F.element_at(F.split("path", "/"), -1).alias("name"),
                    F.col("length").alias("size"), F.col("modificationTime").alias("mtime")))


def fingerprint_files(listing: DataFrame, tasks: int = 200) -> DataFrame:
    """16 hex digits over the size, the first MiB and (above 2 MiB) the last MiB of each file.

    Only those ranges are read, by the tasks; paths must be mounted on the executors.
    """
    mib = 1 << 20
    schema = T.StructType([*listing.schema.fields, T.StructField("file_hash", T.StringType())])

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            marks = []
            for path, size in zip(batch["path"], batch["size"]):
                digest = hashlib.sha1(str(int(size)).encode())
                try:
                    with open(path.removeprefix("file:"), "rb") as f:
                        digest.update(f.read(mib))
                        if size > 2 * mib:
                            f.seek(-mib, 2)
                            digest.update(f.read(mib))
                    marks.append(digest.hexdigest()[:16])
                except OSError:
                    marks.append(None)
            yield batch.assign(file_hash=marks)

    return listing.repartition(tasks).mapInPandas(go, schema)


def upsert_by_key(base: DataFrame, delta: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Newest row per key of base and delta, missing columns filled with NULL."""
    both = base.unionByName(delta, allowMissingColumns=True)
    cols = [c for c in both.columns if c not in keys]
    return (both.groupBy(*keys).agg(F.max_by(F.struct(*cols), version).alias("r"))
            .select(*keys, "r.*"))


def write_clips(clips: DataFrame, path: str) -> None:
    (clips.withColumn("status", F.lit("suggested")).repartition("channel_id", "video_id")
     .write.mode("append").partitionBy("channel_id").parquet(path))


def write_run_report(report: DataFrame, path: str) -> None:
    report.write.mode("append").partitionBy("day").parquet(path)


def cue_clock(ms: Column) -> Column:
    """h:mm:ss.cc of a millisecond time."""
    cs = F.floor((ms + 5) / 10)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60,
                           F.floor(cs / 100) % 60, cs % 100)


def cue_lines(cues: DataFrame) -> DataFrame:
    """One text line per cue: clip_id, cue_no, line."""
    return cues.select("clip_id", "cue_no", F.concat_ws(
        ",", cue_clock(F.col("start_ms")), cue_clock(F.col("end_ms")), F.col("text")).alias("line"))


def write_cues(cues: DataFrame, path: str) -> None:
    """Text files per clip, lines in cue order."""
    (cue_lines(cues).repartition("clip_id").sortWithinPartitions("clip_id", "cue_no")
     .select("clip_id", F.col("line").alias("value"))
     .write.mode("overwrite").partitionBy("clip_id").text(path))


def latest_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    return (df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
            .filter("__rn = 1").drop("__rn"))
