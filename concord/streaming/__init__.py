"""Reconciliation as a stream of micro-batches."""
