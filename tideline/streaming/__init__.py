"""Structured Streaming forms of the ingest and aggregate operators."""
