"""Reference operators and queries, grouped by area."""
