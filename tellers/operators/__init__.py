"""Operators: DataFrames to DataFrames, free of the parliament's tables."""
