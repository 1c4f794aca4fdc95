"""Filters, comparisons, merges, block deltas and summaries over snapshots."""
