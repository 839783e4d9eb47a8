"""Span extraction, tagging and span-level statistics as Spark plans."""
