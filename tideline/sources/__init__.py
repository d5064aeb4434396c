"""Readers and writers: line protocol, hypertables, segment payloads."""
