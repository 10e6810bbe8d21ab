"""Spark-first analytics over typed property graphs, activity logs and retrieval-quality data."""
