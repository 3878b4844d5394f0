"""Operators of the failure-bucketing engine."""
