"""A training-data pipeline: each stage works on all documents that the stage before it kept.

Every stage takes any columns besides doc_id, text, lang and source, whatever their names. Nulls: a null text has no words and is
rejected by the first stage; null ids, languages and sources are values of their own. Ties and repeated rows: equal rows
share every verdict, and of a group of near copies one row stays (the smallest id, null ids last). Empty tables give empty tables, and an
empty benchmark cuts nothing. Long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelgrid.llm import decontaminate, divergence, line_dedup, mixing, set_relations
from reelgrid.llm.texts import written


def _whole(rows: DataFrame, columns: list[str], **new: str) -> DataFrame:
    """The documents carried in `doc`, with some columns replaced."""
    return rows.select(*[F.col(new[c]).alias(c) if c in new else F.col(f"doc.`{c}`").alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    judged = divergence.judge(docs, carry=docs.columns)
    return _whole(judged.where("kept"), docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay only in the last document that holds them."""
    kept = line_dedup.dedup_lines(docs, carry=docs.columns, with_text=True)
    return _whole(kept, docs.columns, text="kept_text")


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return set_relations.one_of_each(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark items are cut out; documents made of them go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; documents it takes nothing of go."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("jaccard_dedup", jaccard_dedup),
          ("decontamination", decontamination), ("source_mix", source_mix)]

#: The distances of the first stage and the automaton are not expressible in SQL; the tests hold run() to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
