"""Continuous runs over change events."""
