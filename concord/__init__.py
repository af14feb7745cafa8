"""Reconciling catalog metadata with Spark: what changed, what is selected, what to write."""
