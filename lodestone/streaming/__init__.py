"""Incremental ingest and roll-ups."""
