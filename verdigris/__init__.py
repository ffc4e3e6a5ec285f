"""Spark-first engine for sampled-answer uncertainty records and grid statistics."""
