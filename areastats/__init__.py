"""Grouped analytics over tables keyed by geographic area, as plain Spark jobs."""
