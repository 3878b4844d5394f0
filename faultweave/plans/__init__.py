"""Plans of the failure-bucketing engine."""
