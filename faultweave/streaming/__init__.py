"""Streaming of the failure-bucketing engine."""
