"""Structured Streaming versions of intake, activity and progress."""
