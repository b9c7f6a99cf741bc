"""Incremental forms of ingest, notification and progress."""
