"""Column functions: paths, globs, sizes, durations, locations."""
