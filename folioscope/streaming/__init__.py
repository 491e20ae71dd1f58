"""Structured Streaming versions of ingest, alerts and debouncing."""
