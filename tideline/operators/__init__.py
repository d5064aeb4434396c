"""Operators over the narrow sample schema: aggregates, windows, joins, rollups, lifecycle."""
