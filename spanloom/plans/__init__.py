"""Whole plans and the queries over the given tables."""
