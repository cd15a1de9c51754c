"""A sample of the registered queries against their SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from check_oracle import TABLES, compare

FOLDER = os.environ.get("REELGRID_TESTDATA", "/root/testdata/sf0.001")
SAMPLE = ["loud_speech_evidence", "merge_used_ranges", "subtract_used", "greedy_by_score", "drop_shared_footage", "snap_to_scene_cuts", "silent_action_islands",
          "local_peaks", "channel_board", "resume_plan", "intake_plan", "rename_results", "adaptive_floor_parts", "reorder_by_reply",
          "language_audit", "group_cues", "align_tokens", "candidate_windows", "throttled_progress", "tile_parts", "reply_rows",
          "split_chapters", "used_pass", "fix_structure", "effect_plan", "snap_parts", "select_judged", "trim_junk_edges", "attach_labels", "table_words"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, con, name):
    n, _, verdict = compare(spark, con, name, entry_module.queries()[name], entry_module.oracle_sql()[name], FOLDER)
    assert verdict == "ok" and n > 0


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
