"""Dataflow operators: pure functions from DataFrames to lazy DataFrames."""
