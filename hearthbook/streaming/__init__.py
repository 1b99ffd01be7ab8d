"""Incremental forms of ingest."""
