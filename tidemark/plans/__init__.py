"""Snapshots derived from the given tables, and the queries over them with their SQL."""
