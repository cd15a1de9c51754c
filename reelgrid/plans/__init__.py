"""Runnable queries over the driver tables, each with the SQL it must agree with."""

from importlib import import_module

MODULES = ("standin_tables", "interval_sets", "signal_islands", "activity_marts", "intake_plans",
           "clip_selection", "transcript_jobs", "caption_cues", "highlights", "event_feeds", "script_parts", "chapter_plans", "script_rewrites", "effect_plans", "timing_plans")



def load_all() -> None:
    for m in MODULES:
        import_module(f"reelgrid.plans.{m}")
