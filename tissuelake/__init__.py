"""Spark-first analytics for single-cell spatial imaging tables."""
