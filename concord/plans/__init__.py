"""Whole plans: a reconciliation cycle, its state, and the query catalogue."""
