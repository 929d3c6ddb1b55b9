"""Readers that turn delivered files into typed DataFrames."""
