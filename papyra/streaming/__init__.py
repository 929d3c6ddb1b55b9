"""Incremental jobs: cursors, micro-batches and small state tables."""
