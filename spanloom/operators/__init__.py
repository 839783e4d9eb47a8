"""Operators on tokens, candidates, spans, tags and annotations."""
