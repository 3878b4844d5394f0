"""Sources of the failure-bucketing engine."""
