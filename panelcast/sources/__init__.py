"""Batch scans, sinks and intermediate tables."""
