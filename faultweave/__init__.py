"""Spark-first failure bucketing and log analytics."""
