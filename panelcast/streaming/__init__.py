"""Incremental pick-up of dropped files."""
