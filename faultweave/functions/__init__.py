"""Functions of the failure-bucketing engine."""
