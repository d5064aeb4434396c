"""From requests to DataFrames: scan plans, rollup routing, JSON queries."""
