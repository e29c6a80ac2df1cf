"""Queries and jobs over the parliament's tables."""
