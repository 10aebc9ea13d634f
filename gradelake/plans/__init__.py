"""Whole jobs: summaries, decisions, reports, planning and validation."""
