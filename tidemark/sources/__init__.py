"""Snapshots from file trees, object inventories and tables, and where results go."""
