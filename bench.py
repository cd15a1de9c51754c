"""Time the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from reelgrid.plans import load_all
from reelgrid.plans.registry import QUERIES
from reelgrid.session import local_session

HEADLINE = ["loud_speech_evidence", "merge_used_ranges", "subtract_used", "covered_fraction", "overlap_pairs", "snap_to_edges",
            "greedy_by_start", "loud_islands", "surprise_rank", "junk_report", "language_audit", "copied_narration",
            "channel_activity", "channel_board", "queue_counts", "intake_plan", "seen_before", "request_dedup",
            "part_numbers", "lane_heads", "remap_words", "word_hold_cues", "job_wait_stats", "error_classes",
            "tile_parts", "signal_evidence", "drop_shared_footage", "group_cues", "used_pass", "fix_structure", "effect_plan"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(name="bench")
    spark.sparkContext.setLogLevel("OFF")
    load_all()
    QUERIES["queue_counts"](spark, folder).collect()          # warm the session up
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(folder).removeprefix("sf")}))


if __name__ == "__main__":
    main()
