"""Spark-first analytics for pitch curves, recited text and training corpora."""
