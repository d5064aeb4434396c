"""Column functions: durations, time buckets, tags, checksums."""
