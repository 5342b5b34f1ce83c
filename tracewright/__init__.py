"""Spark-first code-analytics engine."""
