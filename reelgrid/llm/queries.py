"""Registered queries of the operators, each over its whole tables, with SQL where it can express them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reelgrid.llm import ctw, decontaminate, divergence, licenses, line_dedup, mixing, periodic_runs, pieces, recompression, set_relations, token_cache, turn_repair, url_cascade
from reelgrid.llm.texts import folder

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_read(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).drop("source")


def op3_benchmark_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    rules = spark.createDataFrame(url_cascade.RULES, "host string, path string, verdict string")
    return url_cascade.judge_urls(pages, rules, url_cascade.listed_hosts(pages, url_cascade.BLOCKED_WORDS))


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.dedup_substrings(_read(spark, sf_dir, "documents"))


def op6_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))


def op7_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so that each run shows the cost of a cold one."""
    path = os.path.join(folder(spark), f"token-cache-{uuid.uuid4().hex}")
    return token_cache.token_counts(_read(spark, sf_dir, "documents"), path)


def op8_language_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(_read(spark, sf_dir, "documents"))


def op9_set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_relations.link_components(_read(spark, sf_dir, "documents")).drop("rk", "group")


def op10_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op11_auction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    return turn_repair.repair(turn_repair.damaged(rows), rows)


def op12_piece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find_runs(_read(spark, sf_dir, "documents"), prepare=periodic_runs.looped, seed=periodic_runs.seeds()).drop("n_words")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_context_tree, op2_source_mix, op3_benchmark_automaton, op4_url_cascade, op5_recompression, op6_line_bitmaps, op7_token_cache,
    op8_language_divergence, op9_set_relations, op10_license_templates, op11_auction_repair, op12_piece_spans, op13_periodic_runs)}

_WINDOWS = r"""
with d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
i as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') as s
       from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as k from i where len(w) > 0)),
lens as (select distinct n from iw),
dw as (select doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') as s
       from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as k from d, lens where len(w) >= n)),
m as (select doc_id, k, n, item_id from dw join iw using (n, s)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(k, k + n - 1)) as p from m) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as names from (select distinct doc_id, item_id::varchar as x from m) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""

_LINES = r"""
with l as (select doc_id, k, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
           from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as k from documents)),
s as (select key, max(doc_id) as top from l where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
j as (select l.*, s.top is not null and l.doc_id <> s.top as gone from l left join s using (key))
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by k) filter (where not gone), '')) as kept_sha256
from j group by doc_id
"""

ORACLE: dict[str, str] = {"op2_source_mix": mixing.SQL, "op3_benchmark_automaton": _WINDOWS, "op4_url_cascade": url_cascade.SQL, "op6_line_bitmaps": _LINES}
