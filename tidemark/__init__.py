"""Snapshot comparison, synchronisation and merging as Spark DataFrame jobs."""
