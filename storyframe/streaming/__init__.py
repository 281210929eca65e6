"""Structured Streaming versions of the status and ingest jobs."""
